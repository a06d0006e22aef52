"""The chunk index in storage: immutable segments, snapshots of them, and an inverted index that is maintained by differences.

A *segment* holds some filings' rows (``rows``), their postings (``postings``, both by company) and ``df``: by how much each term's number
of documents changed when the segment came, old filings' postings going and new ones coming. A *manifest* is one snapshot: which segment each
filing lives in, with its rows and terms, and every file with its size and sha256. Files and manifests get names that are never used again.

A change writes its segment, then its manifest under a passing name, and renames that last. The highest manifest is the index, so
whatever fails before the rename leaves the old snapshot and whatever fails after it the new one. A writer that finds its
number taken has lost to another and starts again. Old snapshots stay readable until they are pruned.

Collection statistics follow from the manifest (rows and terms) and the sum of the segments' differences, so replacing a filing reads no
text but the new filing's, and of the old one only its postings. ``compact`` folds all segments into one without reading text.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from vellumgrid.operators import search
from vellumgrid.sources.store import Store
from vellumgrid.sources.tables import keep

REQUIRED = {"company", "fiscal_year", "page", "chunk", "scope", "tokens", "text", "vector"}
KEY = ("company", "fiscal_year", "page", "chunk")
#: Segments of a snapshot beyond which a change compacts them.
MAX_SEGMENTS = 32
#: Filings whose postings a task writes at a time.
OPEN_FILES = 32
#: Times that a change is tried against other writers.
TRIES = 5


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    model: str
    dim: int
    schema: str
    #: company -> segment, rows, terms
    filings: dict[str, tuple[str, int, int]] = field(default_factory=dict)
    #: segment -> part (rows, postings, df) -> [file, bytes, sha256, company]
    segments: dict[str, dict[str, list[tuple[str, int, str, str | None]]]] = field(default_factory=dict)

    def files(self, part: str) -> list[tuple[str, int, str, str | None]]:
        """Files of live filings; of the differences, all."""
        return [f for s, parts in sorted(self.segments.items()) for f in parts.get(part, []) if part == "df" or self.filings.get(f[3], ("",))[0] == s]

    def json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def of(text: str) -> Snapshot:
        raw = json.loads(text)
        raw["filings"] = {c: tuple(v) for c, v in raw["filings"].items()}
        raw["segments"] = {s: {p: [tuple(f) for f in files] for p, files in parts.items()} for s, parts in raw["segments"].items()}
        return Snapshot(**raw)


def _name(version: int) -> str:
    return f"manifests/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in Store(spark, path).names("manifests") if n.endswith(".json") and n[0].isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or an older one that has not been pruned."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no index of version {version} at {path}" if known else f"no index at {path}")
    return Snapshot.of(Store(spark, path).read(_name(known[-1] if version is None else version)))


def _publish(spark: SparkSession, path: str, new: Snapshot) -> None:
    store = Store(spark, path)
    passing = f"manifests/_{new.version:012d}-{uuid.uuid4().hex}"
    store.write(passing, new.json())
    if not store.rename(passing, _name(new.version)):
        store.delete(passing)
        raise Conflict(f"version {new.version} of {path} exists")


def _written(spark: SparkSession, path: str, part: str, segment: str) -> list[tuple[str, int, str, str | None]]:
    """What a segment's part consists of; the checksums are taken where the files are read."""
    folder = f"{path}/{part}/segment={segment}"
    if not Store(spark, path).exists(f"{part}/segment={segment}"):
        return []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length", F.sha2("content", 256)).collect()
    mark = f"/{part}/segment={segment}/"
    inner = [(p.split(mark, 1)[1], n, sha) for p, n, sha in files]
    return sorted((f"{part}/segment={segment}/{p}", n, sha, unquote(p.split("/")[0].removeprefix("company=")) if p.startswith("company=") else None) for p, n, sha in inner)


def _put(frame: DataFrame, path: str, part: str, segment: str, *order: str) -> None:
    # Rebalanced, not repartitioned: a filing of very many rows is split among tasks.
    dealt = frame.hint("rebalance", "company") if part != "df" else frame.hint("rebalance")
    out = dealt.sortWithinPartitions(*order).write.mode("errorifexists")
    (out.partitionBy("company") if part != "df" else out).parquet(f"{path}/{part}/segment={segment}")


def _put_postings(postings: DataFrame, path: str, segment: str) -> None:
    """Postings in the files of their filings, as they come: whoever reads them looks for terms in all, so they are not sorted.

    Tasks hold few filings, so they write with a file open for each, up to OPEN_FILES; only beyond that are postings sorted by filing.
    """
    conf = postings.sparkSession.conf
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key, None)
    conf.set(key, str(OPEN_FILES))
    try:
        postings.write.mode("errorifexists").partitionBy("company").parquet(f"{path}/postings/segment={segment}")
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def _read(spark: SparkSession, path: str, part: str, files: list, schema: t.StructType) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    parted = t.StructType([f for f in schema.fields if f.name != "company"] + [t.StructField("segment", t.StringType()), *(f for f in schema.fields if f.name == "company")])
    return spark.read.schema(parted).option("basePath", f"{path}/{part}").parquet(*[f"{path}/{f[0]}" for f in files]).select(*schema.names)


POSTINGS = t.StructType().add("key", "string").add("company", "string").add("scope", "string").add("length", "integer").add("term", "string").add("tf", "long")
DF = t.StructType().add("term", "string").add("df", "long")


def _segment(chunks: DataFrame, path: str, old_postings: DataFrame) -> tuple[str, dict, dict[str, tuple[str, int, int]]]:
    """Write a segment with these chunks in place of the old postings; its name, files and filings."""
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    _put(chunks, path, "rows", name, "company", "fiscal_year", "page", "chunk")
    parts = {"rows": _written(spark, path, "rows", name)}
    rows = _read(spark, path, "rows", parts["rows"], chunks.schema)
    keyed = rows.withColumn("key", F.concat_ws("|", *[F.col(c).cast("string") for c in KEY]))
    terms = search.term_counts(keyed, carry=("company", "scope")).select(*POSTINGS.names)
    # Terms stay with their rows, which stand in the files of their filing: nothing is dealt out.
    _put_postings(terms, path, name)
    parts["postings"] = _written(spark, path, "postings", name)
    own = _read(spark, path, "postings", parts["postings"], POSTINGS)
    change = own.select("term", F.lit(1).cast("long").alias("df")).unionByName(old_postings.select("term", F.lit(-1).cast("long").alias("df")))
    _put(change.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), path, "df", name, "term")
    parts["df"] = _written(spark, path, "df", name)
    counted = rows.groupBy("company").agg(F.count("*").alias("rows")).join(own.groupBy("company").agg(F.sum("tf").alias("terms")), "company", "left")
    return name, parts, {r["company"]: (name, r["rows"], r["terms"] or 0) for r in counted.collect()}


def _checked(chunks: DataFrame, dim: int) -> DataFrame:
    if missing := REQUIRED - set(chunks.columns):
        raise ValueError(f"the chunks lack {sorted(missing)}")
    right = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} numbers")))
    named = F.when(F.col("company") != "", F.col("company")).otherwise(F.raise_error(F.lit("a chunk has no company")))
    return chunks.withColumns({"vector": right, "company": named})


def write_index(chunks: DataFrame, path: str, model: str, dim: int) -> None:
    """Make an index of these chunks and their terms; one that is there already gets a new snapshot that holds nothing else."""
    spark = chunks.sparkSession
    known = versions(spark, path)
    checked = _checked(chunks, dim)
    name, parts, filings = _segment(checked, path, spark.createDataFrame([], POSTINGS))
    _publish(spark, path, Snapshot((known[-1] if known else 0) + 1, model, dim, checked.schema.json(), filings, {name: parts}))


def replace_filings(chunks: DataFrame, path: str, remove: tuple[str, ...] = ()) -> None:
    """Put these chunks in place of all rows of their companies, and take the companies in ``remove`` out, in one snapshot."""
    spark = chunks.sparkSession
    for attempt in range(TRIES):
        old = snapshot(spark, path)
        schema = t.StructType.fromJson(json.loads(old.schema))
        if missing := set(schema.names) - set(chunks.columns):
            raise ValueError(f"the chunks lack {sorted(missing)}")
        new = keep(_checked(chunks.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), old.dim))
        gone = {r[0] for r in new.select("company").distinct().collect()} | set(remove)
        before = _read(spark, path, "postings", [f for f in old.files("postings") if f[3] in gone], POSTINGS)
        name, parts, filings = _segment(spark.createDataFrame(new.rdd, schema) if new.schema != schema else new, path, before)
        kept = {c: v for c, v in old.filings.items() if c not in gone}
        live = {v[0] for v in kept.values()}
        segments = {s: {p: files for p, files in given.items() if p == "df" or s in live} for s, given in old.segments.items()}
        try:
            _publish(spark, path, Snapshot(old.version + 1, old.model, old.dim, old.schema, kept | filings, segments | {name: parts}))
        except Conflict:
            if attempt + 1 == TRIES:
                raise
            continue
        if len(segments) >= MAX_SEGMENTS:
            compact(spark, path)
        return


def compact(spark: SparkSession, path: str) -> None:
    """Fold all segments into one: rows and postings are copied, differences summed. No text is cut into terms."""
    old = snapshot(spark, path)
    schema, name = t.StructType.fromJson(json.loads(old.schema)), uuid.uuid4().hex
    _put(_read(spark, path, "rows", old.files("rows"), schema), path, "rows", name, "company", "fiscal_year", "page", "chunk")
    _put_postings(_read(spark, path, "postings", old.files("postings"), POSTINGS).hint("rebalance", "company"), path, name)
    _put(document_counts(spark, path, old), path, "df", name, "term")
    parts = {part: _written(spark, path, part, name) for part in ("rows", "postings", "df")}
    filings = {c: (name, rows, terms) for c, (_, rows, terms) in old.filings.items()}
    _publish(spark, path, Snapshot(old.version + 1, old.model, old.dim, old.schema, filings, {name: parts}))


def damaged(spark: SparkSession, path: str, version: int | None = None, content: bool = True) -> list[str]:
    """Files of a snapshot that are missing or differ in size (and, with ``content``, in sha256)."""
    own = snapshot(spark, path, version)
    wanted = {name: (size, sha) for part in ("rows", "postings", "df") for name, size, sha, _ in own.files(part)}
    store = Store(spark, path)
    there = [name for name in wanted if store.exists(name)]
    if not there:
        return sorted(wanted)
    # A file that cannot be read to its end is not read, and so not among the good ones.
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load([f"{path}/{n}" for n in there]).select("path", "length", F.sha2("content", 256) if content else F.lit(None))
    good = set()
    for where, size, sha in read.collect():
        name = next(n for n in (where[where.rindex(f"/{part}/segment=") + 1 :] for part in ("rows", "postings", "df") if f"/{part}/segment=" in where) if n in wanted)
        if size == wanted[name][0] and (not content or sha == wanted[name][1]):
            good.add(name)
    return sorted(set(wanted) - good)


def open_index(spark: SparkSession, path: str, model: str, version: int | None = None, verify: bool = False) -> DataFrame:
    """A snapshot's rows. An index of another model or, with ``verify``, with a file missing or changed is an error."""
    own = snapshot(spark, path, version)
    if own.model != model:
        raise ValueError(f"the index was embedded with {own.model}, not {model}")
    if verify and (wrong := damaged(spark, path, own.version)):
        raise ValueError(f"the index is damaged: {wrong[:5]}")
    return _read(spark, path, "rows", own.files("rows"), t.StructType.fromJson(json.loads(own.schema)))


def document_counts(spark: SparkSession, path: str, own: Snapshot) -> DataFrame:
    """term and df over all live filings: the sum of all differences."""
    return _read(spark, path, "df", own.files("df"), DF).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")


def open_text_index(spark: SparkSession, path: str, version: int | None = None) -> search.TextIndex:
    """Postings, document counts and totals of a snapshot, as ``search.keyword_topk`` takes them; no text is read."""
    own = snapshot(spark, path, version)
    rows, terms = (sum(v[i] for v in own.filings.values()) for i in (1, 2))
    totals = spark.range(1).select(F.lit(rows).cast("long").alias("n_docs"), F.lit(terms / rows if rows else None).cast("double").alias("mean_length"))
    return search.TextIndex(_read(spark, path, "postings", own.files("postings"), POSTINGS), document_counts(spark, path, own), totals)


def prune(spark: SparkSession, path: str, keep_versions: int = 2) -> list[int]:
    """Delete all but the newest snapshots, and the segments that only those used; the versions deleted.

    Manifests go first: what fails in between leaves files that the next pruning finds. Segments without a manifest, as
    failed changes leave them, go too, so no change may be under way.
    """
    store, known = Store(spark, path), versions(spark, path)
    out = known[: max(0, len(known) - max(1, keep_versions))]
    used = {s for v in known[len(out) :] for s in snapshot(spark, path, v).segments}
    for v in out:
        store.delete(_name(v))
    for part in ("rows", "postings", "df"):
        for folder in store.names(part):
            if folder.startswith("segment=") and folder.removeprefix("segment=") not in used:
                store.delete(f"{part}/{folder}")
    for name in store.names("manifests"):
        if name.startswith("_"):
            store.delete(f"manifests/{name}")
    return out


def replaced(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same replacement as a table: old rows of the new chunks' companies give way."""
    return index.join(chunks.select("company").distinct(), "company", "left_anti").unionByName(chunks)


def index_manifest(index: DataFrame) -> DataFrame:
    """company, n_rows, n_pages, tokens and a checksum that does not depend on row order."""
    return index.groupBy("company").agg(
        F.count("*").alias("n_rows"), F.countDistinct("page").alias("n_pages"), F.sum("tokens").alias("tokens"), F.hex(F.bit_xor(F.xxhash64("page", "chunk", "text"))).alias("checksum")
    )


def stale(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows that are in one and not in the other: in ``index`` only (removed) or in ``wanted`` only (added)."""
    return index.exceptAll(wanted).withColumn("change", F.lit("removed")).unionByName(wanted.exceptAll(index).withColumn("change", F.lit("added")))
