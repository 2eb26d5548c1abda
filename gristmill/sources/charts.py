"""A folder of HTML charts by name, and a small server for it."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import unquote


class ChartStore:
    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.manifest = self.folder / "charts.json"
        self.charts: dict[str, str] = json.loads(self.manifest.read_text()) if self.manifest.exists() else {}

    def put(self, name: str, chart) -> Path:
        """Keeps HTML text, or anything that has to_html() or _repr_html_()."""
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError("chart names consist of letters, digits, '_' and '-'")
        maker = next((getattr(chart, m) for m in ("to_html", "_repr_html_") if hasattr(chart, m)), None)
        path = self.folder / f"{name}.html"
        path.write_text(maker() if maker else str(chart))
        self.charts[name] = path.name
        self.manifest.write_text(json.dumps(self.charts))
        return path

    __setitem__ = put

    def __getitem__(self, name: str) -> str:
        return (self.folder / self.charts[name]).read_text()


def serve(store: ChartStore, port: int = 0) -> ThreadingHTTPServer:
    """A server, not yet started, of /charts/<name>."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            name = unquote(self.path.removeprefix("/charts/"))
            found = name in store.charts
            body = store[name].encode() if found else b"not found"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
