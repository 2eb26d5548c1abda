"""Analyses in steps, as a notebook has them, over a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .catalog import Catalog, Source
from .paths import local_or_s3


class AnalysisSession:
    """start() a project, begin() an analysis, take frames from the catalog, and end() it with the result."""

    def __init__(self, catalog: Catalog | None = None, folder=None):
        self.catalog, self.folder = catalog, folder
        self.project = ""
        self.current: tuple[str, str] | None = None
        self.upstream: list[Source] = []

    def start(self, project: str, catalog_file: str, folder: str) -> str:
        """Opens or makes the catalog of a project, whose tables go to folder."""
        self.project, self.catalog, self.folder = project, Catalog(catalog_file), local_or_s3(folder)
        self.current, self.upstream = None, []
        return f"{project}: catalog {catalog_file}, tables in {folder}"

    def begin(self, name: str, version: str, *sources: str) -> dict[str, DataFrame]:
        if self.catalog is None:
            raise RuntimeError("no project has been started")
        self.current, self.upstream = (name, version), []
        return {k: v for s in sources for k, v in self.add_upstream(s).items()}

    def add_upstream(self, source: str) -> dict[str, DataFrame]:
        if not self.current:
            raise RuntimeError("no analysis has begun")
        found = self.catalog[source]
        self.upstream.append(found)
        return {found.name: found.read(self.catalog.spark)}

    def end(self, df: DataFrame) -> Source:
        if not self.current:
            raise RuntimeError("no analysis has begun")
        done = self.catalog.publish(df, *self.current, self.folder, self.upstream)
        self.current, self.upstream = None, []
        return done

    def validation_text(self) -> str:
        well, state = self.catalog.validate()
        lines = [f"{key}: " + ", ".join(f"{k} {'ok' if ok else 'BAD'}" for k, ok in rows) for key, rows in state.items()]
        return "\n".join([f"catalog {'valid' if well else 'INVALID'}", *lines])


def load_magics(shell, session: AnalysisSession, charts=None) -> None:
    """Line magics start_nb, begin_analysis, add_analysis_upstream, end_analysis, validate_catalog and serve_chart for an IPython shell; frames become variables."""
    put = shell.user_ns.update
    shell.register_magic_function(lambda line: print(session.start(*line.split())), "line", "start_nb")
    shell.register_magic_function(lambda line: put(session.begin(*line.split())), "line", "begin_analysis")
    shell.register_magic_function(lambda line: put(session.add_upstream(line.strip())), "line", "add_analysis_upstream")
    shell.register_magic_function(lambda line: session.end(shell.user_ns[line.strip()]), "line", "end_analysis")
    shell.register_magic_function(lambda line: print(session.validation_text()), "line", "validate_catalog")
    if charts is not None:
        shell.register_magic_function(lambda line: charts.put(line.strip(), shell.user_ns[line.strip()]), "line", "serve_chart")
