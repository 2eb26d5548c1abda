"""Reading, writing and keeping: layouts on disk, digests, object columns, the versioned catalog, sessions and charts. These run jobs."""
