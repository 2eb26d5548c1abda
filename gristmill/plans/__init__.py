"""What a physical plan holds, for tests and reviews."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def nodes(df: DataFrame) -> Counter[str]:
    """How often each operator is in df's physical plan, as planned before it runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(m[1] for m in re.finditer(r"(?m)^[\s:+\-*]*(?:\(\d+\) )?(?:\+- |:- )?\*?(?:\(\d+\) )?([A-Z]\w+)", text))
