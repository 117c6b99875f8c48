"""Repeated lines by levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of 128-bit hashes of line keys, bucketed and sorted by the hash. Batches of
documents come in the order of their ids. The keys of a batch, aggregated before they are
shuffled, are merge-anti-joined with each run: what no run holds is new, belongs to the
smallest document of the batch that has it, and becomes a run of level 0. When a level has
``fanout`` runs, they are compacted into one of the next level, so that a batch meets a number
of runs that grows with the logarithm of the number of batches. A manifest in the folder of
the runs says which of them count; a run without an entry there, of a job that was lost, is ignored.

A line is dropped unless its document owns its key in the batch's new run: an anti-join on
hash and document together, so that a line which a third of all documents share is spread by
document. Only hashes and positions travel; each text is shuffled once, at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import bound, materialise, shared_dir, spread

#: Keys of fewer code points are never dropped.
SHORTEST = 10
#: Batches a whole table is cut into, by id, and runs of a level that are compacted into one.
BATCHES, FANOUT = 6, 3
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    plain = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(plain) == F.octet_length(plain), F.lower(plain)).otherwise(F.translate(plain, UPPER, UPPER.lower()))


def cut(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_key(text: Column) -> Column:
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text_key, at (from 0), h1 and h2 of the lines whose key has ``shortest`` code points or more."""
    at = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(cut(F.col("text"))).alias("at", "line"))
    at = at.select("doc_id", "text_key", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= shortest)
    return at.select("doc_id", "text_key", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


@dataclass
class LineRuns:
    """The runs below ``home``, a folder that driver and executors share; opened again it goes on from its manifest."""

    spark: SparkSession
    home: str
    buckets: int
    fanout: int = FANOUT
    step: int = 0
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        try:
            held = self.spark.read.parquet(f"{self.home}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        # One row a run that was live at the last step.
        rows = held.join(held.agg(F.max("step").alias("step")), "step").orderBy("level", "place").collect()
        self.step = rows[0]["step"]
        self.levels = [[] for _ in range(max(r["level"] for r in rows) + 1)]
        for r in rows:
            run, path = r["run"], f"{self.home}/{r['run']}"
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {run} (h1 BIGINT, h2 BIGINT, owner {r['kind']}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {r['buckets']} BUCKETS LOCATION '{path}'"
            )
            self.levels[r["level"]].append(run)

    def runs(self) -> list[str]:
        """Tables of the live runs, the largest level first."""
        return [run for level in reversed(self.levels) for run in level]

    def _write(self, keys: DataFrame, level: int) -> str:
        run = f"line_run_{level}_{uuid4().hex}"
        keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.home}/{run}").saveAsTable(run)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def add(self, keys: DataFrame) -> DataFrame:
        """Those of a batch's distinct keys (h1, h2, owner) that no run holds; they become a run, and levels that are full are compacted."""
        for run in self.runs():
            keys = keys.join(self.spark.table(run), KEY, "left_anti")
        new = self.spark.table(self._write(keys.select(*KEY, "owner"), 0))
        for level in range(len(self.levels)):
            full = self.levels[level]
            if len(full) >= self.fanout:
                merged = self.spark.table(full[0])
                for run in full[1:]:
                    merged = merged.unionByName(self.spark.table(run))
                self.levels[level] = []
                self._write(merged.repartition(self.buckets, *KEY), level + 1)
        self.step += 1
        kind = new.schema["owner"].dataType.simpleString()
        live = [(self.step, level, place, run, self.buckets, kind) for level, runs in enumerate(self.levels) for place, run in enumerate(runs)]
        self.spark.createDataFrame(live, "step int, level int, place int, run string, buckets int, kind string").coalesce(1).write.mode("append").parquet(f"{self.home}/manifest")
        return new


def repeated(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """doc_id, text_key and at of a batch's lines that an earlier batch, or a smaller document of this one, has; the batch joins the runs.

    ``lines`` are keyed_lines, written out.
    """
    # A key of rows without an id alone has no owner, and those rows are one document.
    owned = runs.add(lines.groupBy(*KEY).agg(F.min("doc_id").alias("owner"))).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "owner")
    mine = (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    return lines.join(owned, mine, "left_anti").select("doc_id", "text_key", "at")


def kept_lines(lines: Column, dropped: Column) -> Column:
    """``lines`` without those at the ascending positions ``dropped``, in linear time: the stretches between them."""
    before, after = F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def apply_drops(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """Columns row (all columns of ``docs``), n_lines, n_dropped, kept_text, one row per row of ``docs``; ``drops`` as repeated() returns them."""
    lists = drops.groupBy(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key")).agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("r_id"), text_key(F.col("text")).alias("r_key"))
    held = rows.join(lists, F.col("r_id").eqNullSafe(F.col("d_id")) & (F.col("r_key") == F.col("d_key")), "left")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))

    def both(lines: Column) -> Column:
        whole = F.when(F.col("dropped").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(F.array_join(kept_lines(lines, gone), "\n"))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), whole.alias("text"))

    done = held.select("row", F.size(gone).cast("long").alias("n_dropped"), bound(cut(F.col("row.text")), both).alias("done"))
    return done.select("row", "done.n_lines", "n_dropped", F.col("done.text").alias("kept_text"))


def deduplicate_lines(docs: DataFrame, batches: int = BATCHES, shortest: int = SHORTEST, fanout: int = FANOUT) -> DataFrame:
    """Every document without the lines that a document of smaller id has; columns as apply_drops() returns them.

    ``doc_id`` is a number. Rows that share a doc_id are one document; rows without one are
    one document that comes last. A null text is empty, and an empty text is one empty line.
    Keys shorter than ``shortest`` code points stay, and so do lines that repeat within their
    smallest document only. Texts may be of any length. An empty table gives an empty one;
    columns beyond doc_id and text travel in ``row`` untouched, whatever their names.
    """
    spark = docs.sparkSession
    home = f"{shared_dir(spark)}/tables/lines-{uuid4().hex}"
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = sum((F.coalesce((F.col("doc_id") > c).cast("int"), F.lit(1)) for c in sorted(set(cuts or []))), F.lit(0))
    lines = keyed_lines(docs, shortest).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(f"{home}/all")
    lines = spark.read.schema(lines.schema).parquet(f"{home}/all")
    runs, drops = LineRuns(spark, f"{home}/runs", spread(docs), fanout), None
    for no in range(len(set(cuts or [])) + 1):
        found = materialise(repeated(lines.where(F.col("batch") == no).drop("batch"), runs), "repeated-lines")
        drops = found if drops is None else drops.unionByName(found)
    return apply_drops(docs, drops)


def digest(docs: DataFrame) -> DataFrame:
    """The op12 columns of documents."""
    done = deduplicate_lines(docs.select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
