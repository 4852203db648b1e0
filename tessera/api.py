"""The facade: a knowledge base of papers in a folder of Parquet tables (§2.13). Every read gives a DataFrame."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import storage
from tessera.catalog import Catalog
from tessera.functions import text as X
from tessera.operators import composite, documents, relational, search, sequences
from tessera.sources import readers, writers


def _whole(method):
    """What a method writes to several tables becomes one commit."""

    @wraps(method)
    def inside(self, *args, **more):
        with self.tables.transaction():
            return method(self, *args, **more)

    return inside


class PaperBase:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Catalog(spark, root)

    def _read(self, name: str) -> DataFrame:
        return self.tables.read(name)

    def _active(self, name: str) -> DataFrame:
        return relational.active(self._read(name), self._read("processing_runs"))

    # papers and files

    @_whole
    def upsert_papers(self, papers: DataFrame) -> None:
        """DML01: rows match by DOI, then by paper_key; a missing value never erases one. New papers get ids."""
        have = self._read("papers")
        ids = have.select("id", F.col("doi").alias("_doi"), F.col("paper_key").alias("_key"))
        p = papers.drop("id")
        if "doi" not in p.columns:
            p = p.withColumn("doi", F.lit(None).cast("string"))
        by_doi = p.join(ids.filter("_doi IS NOT NULL").select("_doi", F.col("id").alias("_a")), F.col("doi") == F.col("_doi"), "left").drop("_doi")
        both = by_doi.join(ids.select("_key", F.col("id").alias("_b")), F.col("paper_key") == F.col("_key"), "left").drop("_key")
        known = both.withColumn("id", F.coalesce("_a", "_b")).drop("_a", "_b")
        old = known.filter("id IS NOT NULL")
        fresh = known.filter("id IS NULL").drop("id").dropDuplicates(["paper_key"])
        fresh = relational.start_ids(fresh.withColumn("_o", F.abs(F.xxhash64("paper_key")) / 2**40), "_o", self.tables.next_id("papers") - 1).drop("_o")
        source = old.unionByName(fresh).withColumn("updated_at", F.current_timestamp())
        keys = [c for c in have.columns if c not in ("id", "paper_key")]
        source = source.select("id", "paper_key", *(F.col(c) if c in source.columns else F.lit(None).cast(have.schema[c].dataType).alias(c) for c in keys))
        merged = have.alias("t").join(source.alias("s"), "id", "full_outer").select("id", F.coalesce("t.paper_key", "s.paper_key").alias("paper_key"), *(F.coalesce(f"s.{c}", f"t.{c}").alias(c) for c in keys))
        self.tables.write("papers", merged.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())))

    def get_paper(self, key) -> DataFrame:
        """FIL01: by id, else by key, DOI or the number a text spells, in this order."""
        p = self._read("papers")
        if isinstance(key, int):
            return p.filter(F.col("id") == key)
        turn = F.when(F.col("paper_key") == key, 1).when(F.col("doi") == str(key).lower(), 2).when(F.col("id").cast("string") == key, 3)
        return p.withColumn("_t", turn).filter("_t IS NOT NULL").orderBy("_t").limit(1).drop("_t")

    def describe_paper(self, key) -> DataFrame:
        p = self.get_paper(key)
        files = self._read("paper_files").groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_list("path")).alias("files"))
        tags = self.get_tags().groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_set(F.concat_ws(":", "category", "name"))).alias("tags"))
        return p.join(files, "id", "left").join(tags, "id", "left").join(self.get_summary().select(F.col("paper_id").alias("id"), F.col("content").alias("summary")), "id", "left")

    def list_papers(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return relational.page(self._read("papers"), "id", limit, offset)

    def add_files(self, files: DataFrame) -> None:
        """DML04: paths that are new."""
        self.tables.write("paper_files", relational.insert_ignore(self._read("paper_files"), files.select(*(F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in self._read("paper_files").dtypes)), ["path"]))

    def get_files(self, paper_id: int) -> DataFrame:
        return self._read("paper_files").filter(F.col("paper_id") == paper_id).orderBy(F.desc("is_preferred"), "id")

    def set_preferred_file(self, paper_id: int, file_id: int) -> None:
        chosen = self.spark.createDataFrame([(paper_id, file_id)], "paper_id long, file_id long")
        self.tables.write("paper_files", relational.preferred_file(self._read("paper_files"), chosen))

    def scan_folder(self, folder: str, pattern: str = "*.md", recursive: bool = True) -> DataFrame:
        """SRC01, SRC02: path, sha256, outcome of the files of a folder: existing_path, hash_known or created."""
        found = readers.with_hashes(readers.files(self.spark, folder, pattern, recursive))
        have = self._read("paper_files").select(F.col("path").alias("_p"), F.col("sha256").alias("_h"))
        seen = found.join(have.select("_p").distinct(), F.col("path") == F.col("_p"), "left").join(have.select("_h").distinct(), F.col("sha256") == F.col("_h"), "left")
        return seen.select("path", "sha256", F.when(F.col("_p").isNotNull(), "existing_path").when(F.col("_h").isNotNull(), "hash_known").otherwise("created").alias("outcome"))

    @_whole
    def ingest_folder(self, folder: str, pattern: str = "*.md") -> DataFrame:
        """CMP14, CMP08: new files become papers with units; a file whose content is known is skipped. Returns the outcomes."""
        outcomes = self.scan_folder(folder, pattern).persist()
        new = outcomes.filter("outcome = 'created'").dropDuplicates(["sha256"])
        texts = readers.files(self.spark, folder, pattern).select("path", F.decode("content", "utf-8").alias("text")).join(new, "path")
        title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
        keyed = texts.withColumn("title", title).withColumn("paper_key", F.concat_ws("_", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.substring("sha256", 1, 8)))
        self.upsert_papers(keyed.select("paper_key", "title", F.col("path").alias("markdown_path"), X.find_doi(F.col("text")).alias("doi"), X.find_year(F.col("text")).alias("year")))
        ids = self._read("papers").select(F.col("id").alias("paper_id"), "paper_key")
        known = keyed.join(ids, "paper_key")
        self.add_files(known.select(F.abs(F.xxhash64("path")).alias("id"), "paper_id", "path", "sha256", F.lit("markdown").alias("file_role"), F.lit(1).alias("is_preferred"), F.lit(1).alias("exists_now")))
        units = documents.search_units(known.select("paper_id", "text"), "paper_id")
        self.tables.append("search_units", units.select((F.col("paper_id") * 1_000_000 + F.col("ordinal")).alias("id"), "paper_id", "unit_type", "section_path", "content"))
        equations = documents.equations(known.select("paper_id", "text"), "paper_id")
        self.tables.append("equations", equations.select((F.col("paper_id") * 1_000_000 + F.col("ordinal")).alias("id"), "paper_id", F.col("latex").alias("latex_raw"), X.normalize_latex(F.col("latex")).alias("latex_normalized"), X.equation_number(F.col("latex")).alias("equation_number")))
        return outcomes

    # search

    def _units(self) -> DataFrame:
        return self._active("search_units").select(F.col("id").alias("unit_id"), "paper_id", F.concat_ws(" ", "content", "section_path").alias("content"))

    def search(self, query: str, limit: int = 10, preferred=(), excluded=(), years: tuple[int, int] | None = None, explain: bool = False) -> DataFrame:
        """FTS07, FTS13: the best papers with score and its parts."""
        papers = self._read("papers").select(F.col("id").alias("paper_id"), "paper_key", "title", F.concat_ws(" ", "abstract", "essence").alias("body"), "year")
        return search.search(self.index(), papers, self.get_tags(), query, limit, preferred, excluded, years, explain)

    def index(self) -> search.Index:
        """The stored index of the present units; built when units or runs have changed since the last one."""
        path = f"{self.tables.root}/index/v={self.tables.version('search_units')}-{self.tables.version('processing_runs')}"
        done = search.Index(self.spark, path)
        return done if self.tables.exists(f"{path}/figures/_SUCCESS") else search.Index.build(self._units(), path)

    def explain_match(self, query: str, paper_key: str) -> DataFrame:
        """FTS11."""
        return self.search(query, 50, explain=True).filter(F.col("paper_key") == paper_key)

    def search_results(self, query: str, limit: int = 20) -> DataFrame:
        """FTS13: a search as fixed columns."""
        return search.projected(self.search(query, limit), self._read("papers").withColumnRenamed("id", "paper_id"))

    def get_related(self, paper_id: int, limit: int = 10) -> DataFrame:
        return search.related(self.get_tags(), paper_id, limit)

    def retrieve_context(self, query: str, budget: int = 24_000) -> DataFrame:
        """CMP01: units of the best papers that fit into a budget of estimated tokens, in order of paper and unit."""
        papers = self.search(query, 500, explain=True)
        text, _ = search.split_query(query)
        units = self.index().bm25(search.query_phrases(self.spark, text), papers).orderBy("rank", "unit_id").limit(500)
        joined = units.join(self._units().select("unit_id", "content"), "unit_id").join(papers.select("paper_id", "score"), "paper_id")
        placed = joined.withColumn("order", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "rank", "unit_id")).cast("long")).withColumn("pack", F.lit(0))  # at most 500 rows
        return placed.join(sequences.fill_budget(placed, "pack", "order", X.estimated_tokens(F.col("content")), budget), ["pack", "order"]).select("order", "paper_id", "unit_id", "content").orderBy("order")

    def find_missing(self, field: str) -> DataFrame:
        """FIL11."""
        columns = {"bibtex": "bibtex_path", "markdown": "markdown_path", "json": "json_path"}
        papers = self._read("papers")
        if field in columns:
            return relational.blank(papers, columns[field])
        others = {"summary": self._active("summaries"), "pdf": self._read("paper_files").filter("lower(path) LIKE '%.pdf'")}
        if field not in others:
            raise ValueError(f"unknown field: {field}")
        return relational.missing(papers, others[field].select(F.col("paper_id").alias("id")), "id")

    def migrate(self, legacy: DataFrame, tags: DataFrame, article_tags: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
        """CMP16: papers of an older database become papers here; returns those found in it."""
        found = composite.migrate(legacy, tags, article_tags, rules)["papers"]
        self.upsert_papers(found)
        return found

    def import_bibtex(self, texts: DataFrame, files: DataFrame) -> DataFrame:
        """SRC22, CMP16: entries of BibTeX texts (path, text) become papers with the file they name; returns what was matched."""
        entries = readers.bibtex(texts)
        key = F.regexp_replace("entry_id", "[^A-Za-z0-9_]", "")
        outcome = storage.written(readers.import_entries(entries.withColumn("entry_id", key), self._read("papers"), files))
        new = entries.withColumn("paper_key", key).join(outcome.filter("was_new").select(F.col("entry_id").alias("paper_key")), "paper_key", "left_semi")
        self.upsert_papers(new.select("paper_key", "doi", "title", F.col("authors").alias("authors_text"), "year", "journal", "abstract", "keywords"))
        ids = self._read("papers").select(F.col("id").alias("_id"), F.col("paper_key").alias("entry_id"))
        known = outcome.join(ids, "entry_id", "left").withColumn("paper_id", F.coalesce("paper_id", "_id")).drop("_id")
        self.add_files(known.filter("path IS NOT NULL").select(F.abs(F.xxhash64("path")).alias("id"), "paper_id", "path", F.lit("mendeley").alias("file_role"), F.lit(1).alias("exists_now")))
        return known

    # what was extracted

    def get_equations(self, paper_id: int) -> DataFrame:
        return self._active("equations").filter(F.col("paper_id") == paper_id).orderBy("id")

    def get_equation_variables(self, equation_id: int) -> DataFrame:
        return self._read("equation_variables").filter(F.col("equation_id") == equation_id)

    def find_equations(self, variables: list[str]) -> DataFrame:
        """FIL16."""
        symbols = self._read("equation_variables").select(F.col("equation_id").alias("id"), F.lower("symbol").alias("symbol"))
        return relational.subset_of(symbols, "id", "symbol", [v.lower() for v in variables])

    def get_methods(self, paper_id: int | None = None) -> DataFrame:
        m = self._active("methods")
        return m if paper_id is None else m.filter(F.col("paper_id") == paper_id).orderBy("id")

    def find_methods(self, query: str, limit: int = 10) -> DataFrame:
        """FTS12."""
        return self.search(query, limit).join(self.get_methods().select("paper_id", "name", "purpose"), "paper_id", "left")

    def compare_methods(self, paper_ids: list[int], axes: list[str]) -> DataFrame:
        """CMP04, JSN03: one row per paper, its first method's card by axis, N/A where there is none."""
        first = self.get_methods().filter(F.col("paper_id").isin(paper_ids)).groupBy("paper_id").agg(F.min_by("card_json", "id").alias("card"))
        papers = self._read("papers").filter(F.col("id").isin(paper_ids)).select(F.col("id").alias("paper_id"), "paper_key")
        return papers.join(first, "paper_id", "left").select("paper_id", "paper_key", *(F.coalesce(F.get_json_object("card", f"$.{a}"), F.lit("N/A")).alias(a) for a in axes))

    def get_summary(self) -> DataFrame:
        s = self._read("summaries")
        return s.join(relational.active_summaries(s, self._read("processing_runs")), ["paper_id", "id"], "left_semi")

    def get_markdown(self, key) -> DataFrame:
        paths = [r[0] for r in self.get_paper(key).select("markdown_path").limit(1).collect() if r[0]]
        return self.spark.read.text(paths, wholetext=True) if paths else self.spark.createDataFrame([], "value string")

    def get_json(self) -> DataFrame:
        papers = self._read("papers").select(F.col("id").alias("paper_id"), "paper_key", "doi", "title", "year")
        return writers.companions(papers, self.get_tags())

    def get_bibtex(self) -> DataFrame:
        """SNK03."""
        entry = writers.bibtex_entry(F.col("paper_key"), title=F.col("title"), author=F.col("authors_text"), year=F.col("year"), journal=F.col("journal"), doi=F.col("doi"))
        return self._read("papers").select("paper_key", entry.alias("bibtex"))

    # tags

    def get_tags(self) -> DataFrame:
        """paper_id, name, category, source."""
        t = self._read("tags").select(F.col("id").alias("tag_id"), F.col("canonical_name").alias("name"), "category")
        return self._read("paper_tags").join(t, "tag_id").select("paper_id", "name", "category", "source")

    def list_tags(self, category: str | None = None) -> DataFrame:
        """FIL10, AGG02."""
        counts = self._read("paper_tags").groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("count"))
        t = self._read("tags").join(counts, "id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        return (t if category is None else t.filter(F.col("category") == category)).orderBy("category", "canonical_name")

    def get_tag_aliases(self, name: str) -> DataFrame:
        ids = self._read("tags").filter(F.lower("canonical_name") == name.lower()).select(F.col("id").alias("tag_id"))
        return self._read("tag_aliases").join(ids, "tag_id", "left_semi")

    def resolve_tag(self, name: str, category: str | None = None) -> DataFrame:
        """CMP12: tags with this canonical name, or else all that have it as an alias."""
        t = self._read("tags") if category is None else self._read("tags").filter(F.col("category") == category)
        own = t.filter(F.lower("canonical_name") == name.lower()).withColumn("turn", F.lit(0))
        alias = t.join(self._read("tag_aliases").filter(F.col("normalized_alias") == name.lower().strip()).select(F.col("tag_id").alias("id")), "id", "left_semi").withColumn("turn", F.lit(1))
        both = own.unionByName(alias)
        return both.join(both.agg(F.min("turn").alias("turn")), "turn", "left_semi").drop("turn")

    @_whole
    def add_user_tags(self, paper_id: int, tags: list[str]) -> None:
        """DML22."""
        pairs = [(c, n) if m else ("user", c) for c, m, n in (t.replace("_", " ").partition(":") for t in tags)]
        wanted = self.spark.createDataFrame([(n, c) for c, n in pairs], "canonical_name string, category string")
        have = self._read("tags")
        fresh = wanted.distinct().join(have, ["canonical_name", "category"], "left_anti").withColumn("_o", F.abs(F.xxhash64("canonical_name", "category")) / 2**40)
        self.tables.write("tags", have.unionByName(relational.start_ids(fresh, "_o", self.tables.next_id("tags") - 1).select(have.columns)))
        ids = self._read("tags").join(wanted, ["canonical_name", "category"], "left_semi")
        links = ids.select(F.lit(paper_id).cast("long").alias("paper_id"), F.col("id").alias("tag_id"), F.lit("user").alias("source"), F.lit(None).cast("long").alias("run_id"), F.lit(1.0).alias("confidence"), F.col("canonical_name").alias("raw_name"))
        self.tables.write("paper_tags", relational.insert_ignore(self._read("paper_tags"), links, ["paper_id", "tag_id", "source"]))

    @_whole
    def merge_tags(self, keep: int, gone: int) -> None:
        """DML16: links and aliases of one tag move to another, its name becomes an alias."""
        name = self._read("tags").filter(F.col("id") == gone).select(F.lit(keep).cast("long").alias("tag_id"), F.col("canonical_name").alias("alias"), F.lower("canonical_name").alias("normalized_alias"))
        self.tables.write("paper_tags", relational.merge_tags(self._read("paper_tags"), "tag_id", gone, keep, ["paper_id", "tag_id", "source"]))
        self.tables.write("tag_aliases", relational.merge_tags(self._read("tag_aliases").unionByName(name), "tag_id", gone, keep, ["tag_id", "normalized_alias"]))
        self.tables.write("tags", self._read("tags").filter(F.col("id") != gone))

    # state

    def processing_status(self) -> DataFrame:
        """AGG06."""
        return relational.latest(self._read("processing_runs"), ["paper_id", "operation"], "status", "id")

    def status(self) -> DataFrame:
        """AGG01: metric, n."""
        one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        tables = {"papers": self._read("papers"), "files": self._read("paper_files"), "units": self._read("search_units"), "tags": self._read("tags"), "links": self._read("paper_tags"), "equations": self._active("equations"), "methods": self._active("methods"), "with_summary": self.get_summary(), "with_markdown": self._read("papers").filter("markdown_path IS NOT NULL"), "runs": self._read("processing_runs"), "topics": self._read("topics")}
        out = None
        for name, df in tables.items():
            out = one(df, name) if out is None else out.unionAll(one(df, name))
        return out

    @_whole
    def build_topic(self, name: str, query: str, limit: int = 20) -> DataFrame:
        """CMP05: the papers of a search saved as a topic, with 1 / place as their match score."""
        have = self._read("topics")
        topic = have.filter(F.col("name") == name).agg(F.min("id")).first()[0] or self.tables.next_id("topics")
        row = self.spark.createDataFrame([(topic, name, query)], "id long, name string, description string").withColumn("created_at", F.current_timestamp())
        self.tables.write("topics", relational.insert_ignore(have, row, ["name"]))
        found = self.search(query, limit)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "paper_key"))  # at most `limit` rows
        links = found.select(F.lit(topic).cast("long").alias("topic_id"), "paper_id", F.lit("search").alias("relevance"), (1 / place).alias("match_score"))
        self.tables.write("topic_papers", relational.insert_ignore(self._read("topic_papers"), links, ["topic_id", "paper_id"]))
        return self._read("topic_papers").filter(F.col("topic_id") == topic)
