"""The tables of a knowledge base (§1.3) as Parquet folders, with integrity checks in place of constraints."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import commits

#: Names and types of all columns.
SCHEMAS = {
    "papers": "id long, paper_key string, doi string, arxiv_id string, title string, authors_text string, year int, journal string, abstract string, keywords string, essence string, markdown_path string, json_path string, bibtex_path string, created_at timestamp, updated_at timestamp",
    "paper_files": "id long, paper_id long, path string, file_role string, version_label string, file_size long, modified_time double, sha256 string, exists_now int, is_preferred int, last_seen timestamp",
    "processing_runs": "id long, paper_id long, operation string, backend string, backend_version string, model_name string, prompt_version string, configuration_json string, config_hash string, source_file_id long, input_sha256 string, output_path string, supersedes_run_id long, status string, started_at timestamp, finished_at timestamp, message string",
    "search_units": "id long, paper_id long, run_id long, unit_type string, source_type string, source_id long, section_path string, page_from int, page_to int, content string",
    "tags": "id long, canonical_name string, category string",
    "tag_aliases": "tag_id long, alias string, normalized_alias string",
    "paper_tags": "paper_id long, tag_id long, source string, run_id long, confidence double, raw_name string",
    "equations": "id long, paper_id long, run_id long, latex_raw string, latex_normalized string, equation_number string, section_path string, page_number int, bbox_json string, context_before string, context_after string, parser string, confidence double, verification_status string",
    "equation_variables": "id long, equation_id long, symbol string, meaning string, source_page int, source_context string",
    "methods": "id long, paper_id long, run_id long, name string, method_type string, purpose string, complexity string, confidence double, card_json string, source_passages_json string, created_at timestamp",
    "method_equations": "method_id long, equation_id long, role string",
    "summaries": "id long, paper_id long, run_id long, model_name string, prompt_version string, content string, timestamp timestamp, is_active int",
    "topics": "id long, name string, description string, created_at timestamp",
    "topic_papers": "topic_id long, paper_id long, relevance string, match_score double",
    "citations": "citing_paper_id long, cited_doi string, cited_title string, matched_paper_id long",
}
#: Keys that must be unique, and references that must exist.
UNIQUE = {"papers": [["id"], ["paper_key"], ["doi"]], "paper_files": [["path"]], "tags": [["id"], ["canonical_name", "category"]], "tag_aliases": [["tag_id", "normalized_alias"]], "topics": [["name"]], "topic_papers": [["topic_id", "paper_id"]], "citations": [["citing_paper_id", "cited_doi"]]}
REFERENCES = [("paper_files", "paper_id", "papers"), ("search_units", "paper_id", "papers"), ("paper_tags", "paper_id", "papers"), ("paper_tags", "tag_id", "tags"), ("tag_aliases", "tag_id", "tags"), ("equations", "paper_id", "papers"), ("methods", "paper_id", "papers"), ("summaries", "paper_id", "papers"), ("equation_variables", "equation_id", "equations")]


class Catalog:
    """Tables by name. A table is a list of Parquet folders, which a log of commits over all tables keeps.

    A reader takes all tables from one commit. An append writes its own rows only. A table that this catalog has read is replaced
    only if nobody has changed it since; otherwise the write raises commits.Conflict, and the caller reads again.
    """

    #: Folders of a table from which on compact() writes it anew.
    MANY = 50

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = commits.Log(spark, self.root)
        self._seen: dict[str, commits.State] = {}  # the state in which a table was read last
        self._open: dict | None = None  # a transaction's base, changes and reads

    def init(self) -> None:
        """TXN01: makes the tables known that aren't yet, without rows."""
        now = self.log.state()
        missing = [name for name in SCHEMAS if name not in now.values]
        if missing:
            self.log.commit(now, add={name: [] for name in missing})

    @contextmanager
    def transaction(self):
        """TXN01: the writes within become one commit, or none if it fails; an inner transaction is part of the outer.

        Within, tables are as they were at its beginning, with its own writes. Tables that were read or replaced within must not
        have been changed by others at the end: then Conflict is raised, and what was written is deleted.
        """
        if self._open is not None:
            yield self
            return
        self._open = {"base": self.log.state(), "set": {}, "add": {}, "reads": set(), "written": []}
        try:
            yield self
            t = self._open
            if t["set"] or t["add"]:
                self._committed(self.log.commit(t["base"], t["set"], t["add"], t["reads"]), t["set"])
        except BaseException:
            for path in self._open["written"]:
                p, fs = self._fs(path)
                fs.delete(p, True)
            raise
        finally:
            self._open = None

    def _committed(self, state: commits.State, replaced) -> None:
        self._seen |= {name: state for name in replaced}

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _fs(self, path: str):
        return commits.file_system(self.spark, path)

    def version(self, name: str) -> int:
        """The commit that changed the table last; 0 if there is none."""
        return self.log.state().changed.get(name, 0)

    def paths(self, name: str, at: int | None = None) -> list[str]:
        """The folders that hold the table's rows now, in the open transaction, or at a commit."""
        t = self._open
        if t is None or at is not None:
            state = self.log.state(at)
            if at is None:
                self._seen[name] = state
            return state.values.get(name, [])
        if name not in t["set"]:
            t["reads"].add(name)
        return t["set"].get(name, t["base"].values.get(name, [])) + t["add"].get(name, [])

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """The table; at: as of a commit."""
        if found := self.paths(name, at):
            return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{x}" for x in found))
        return self.spark.createDataFrame([], SCHEMAS[name])

    def _stored(self, name: str, rows: DataFrame) -> str:
        kept = f"{name}/{uuid.uuid4().hex}"
        kinds = dict(c.split() for c in SCHEMAS[name].split(", "))
        rows.select(*(F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items())).write.parquet(f"{self.root}/{kept}")
        if self._open is not None:
            self._open["written"].append(f"{self.root}/{kept}")
        return kept

    def write(self, name: str, rows: DataFrame) -> None:
        """DML05: replaces the table by the rows; columns that they lack are null."""
        kept = self._stored(name, rows)
        if self._open is not None:
            self._open["set"][name] = [kept]
            self._open["add"].pop(name, None)
        else:
            self._committed(self.log.commit(self._seen.get(name) or self.log.state(), set_={name: [kept]}), [name])

    def append(self, name: str, rows: DataFrame) -> None:
        """DML06: adds the rows; writes nothing else and never conflicts with other appends."""
        kept = self._stored(name, rows)
        if self._open is None:
            self.log.commit(self.log.state(), add={name: [kept]})
        elif name in self._open["set"]:
            self._open["set"][name] = [*self._open["set"][name], kept]
        else:
            self._open["add"].setdefault(name, []).append(kept)

    def compact(self, name: str) -> None:
        """Writes a table of many folders as one, the rows unchanged."""
        if len(self.paths(name)) >= self.MANY:
            self.write(name, self.read(name))

    def next_id(self, name: str) -> int:
        return (self.read(name).agg(F.max("id")).first()[0] or 0) + 1

    def violations(self) -> DataFrame:
        """check, n: how many keys are double and how many references lead nowhere."""
        out = self.spark.createDataFrame([], "check string, n long")
        for name, keys in UNIQUE.items():
            for key in keys:
                rows = self.read(name).dropna(subset=key).groupBy(*key).count().filter("count > 1")
                out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(f"{name}: unique {', '.join(key)}").alias("check"), "n"))
        preferred = self.read("paper_files").filter("is_preferred = 1").groupBy("paper_id").count().filter("count > 1")
        out = out.unionByName(preferred.agg(F.count("*").alias("n")).select(F.lit("paper_files: one preferred").alias("check"), "n"))
        for name, column, other in REFERENCES:
            rows = self.read(name).dropna(subset=[column]).join(self.read(other).select(F.col("id").alias(column)), column, "left_anti")
            out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(f"{name}.{column}: in {other}").alias("check"), "n"))
        return out
