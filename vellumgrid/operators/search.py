"""Filtered vector and keyword search, reciprocal rank fusion and context packing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T
from vellumgrid.sources.tables import keep

#: Bytes up to which a counted table is sent to every executor.
BROADCAST_BYTES = 48 << 20
QUERY_BLOCK = 1024
#: Rows of a block where neither side is sent everywhere.
BLOCK_ROWS = 4096
#: Documents, and scores, that are made at a time.
SCORED_ROWS = 256
SCORES = 1 << 20


def in_scope(index: DataFrame, company: str | None = None, scope: str | None = None) -> DataFrame:
    """Rows of one filing and of one statement scope; unstated and mixed pages belong to both."""
    if scope is not None and scope not in {"standalone", "consolidated"}:
        raise ValueError("scope is standalone or consolidated")
    if company is not None:
        index = index.where(F.col("company") == company)
    return index if scope is None else index.where(F.col("scope").isin(scope, "unstated", "mixed"))


def unit(vector: Column) -> Column:
    """A vector of length one, as doubles."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / norm)


def _blocks(table: DataFrame, by: str, columns: list[Column], name: str, company: bool) -> DataFrame:
    """Rows packed into about BLOCK_ROWS a block, by company if wanted and by a hash of ``by``."""
    keyed = table.withColumn("g", F.coalesce("c", F.lit("")) if company else F.lit(""))
    counted = keyed.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("n"))
    return keyed.join(counted, "g").groupBy("g", F.pmod(F.xxhash64(by), F.col("n")).alias("b")).agg(F.collect_list(F.struct(*columns)).alias(name)).select("g", name)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


class _Asked:
    """Questions as a matrix, found by the company they ask."""

    def __init__(self, names: pa.Array, vectors: pa.Array, companies: pa.Array, scopes: pa.Array):
        self.names, self.kind, self.matrix = names.to_pylist(), names.type, _matrix(vectors)
        self.scopes = np.array([x or "" for x in scopes.to_pylist()], dtype=object)
        self.of: dict[str | None, list[int]] = {}
        for i, company in enumerate(companies.to_pylist()):
            self.of.setdefault(company, []).append(i)

    def best(self, names: pa.Array, vectors: pa.Array, companies: pa.Array, scopes: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
        """The k best rows for each question that these rows may answer."""
        keys, companies, scopes = np.array(names.to_pylist()), np.array(companies.to_pylist(), dtype=object), np.array(scopes.to_pylist(), dtype=object)
        vectors = _matrix(vectors)
        for company, places in [(None, np.arange(len(keys)))] + [(c, np.flatnonzero(companies == c)) for c in set(companies.tolist()) if c is not None]:
            asking = np.array(self.of.get(company, []), dtype=np.int64)
            for at in range(0, len(asking), QUERY_BLOCK):
                block = asking[at : at + QUERY_BLOCK]
                out_q, out_k, out_s = [], [], []
                for q, s in zip(block.tolist(), self.matrix[block] @ vectors[places].T, strict=True):
                    ok = np.flatnonzero((scopes[places] == self.scopes[q]) | np.isin(scopes[places], ("unstated", "mixed"))) if self.scopes[q] else np.arange(len(places))
                    order = ok[np.lexsort((keys[places[ok]], -s[ok]))[:k]]
                    out_q += [self.names[q]] * len(order)
                    out_k += keys[places[order]].tolist()
                    out_s += s[order].tolist()
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, self.kind), pa.array(out_k, names.type), pa.array(out_s, pa.float64())], names=["q", "k", "s"])


def vector_topk(index: DataFrame, queries: DataFrame, k: int = X.FUSION_DEPTH, key: str = "key", vector: str = "vector", query: str = "question_id", company: str | None = None, scope: str | None = None, of: str = "company") -> DataFrame:
    """question_id, key, score and rank of the k nearest rows by dot product.

    ``queries``: question_id, vector and, if named, the company and scope each asks (null: any); the rows' are in
    ``of`` and ``scope``. Queries counted small are sent to every task, which multiplies them with its rows in
    blocks and lets only the best k of each block pass on. More of them are packed into blocks by company, which meet the blocks of
    their own company's rows by an equality join; only questions that ask any company meet all blocks. Ties go to the smaller key.
    """
    none = F.lit(None).cast("string")
    asked = keep(queries.select(F.col(query).alias("q"), F.col(vector).alias("v"), (F.col(company) if company else none).alias("c"), (F.col(scope) if scope else none).alias("s")))
    kind, name_kind = dict(index.dtypes)[key], dict(queries.dtypes)[query]
    rows = index.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(of) if company else none).alias("c"), (F.col("scope") if scope else none).alias("s"))
    schema = f"q {name_kind}, k {kind}, s double"
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if size["n"] * (8 * (size["width"] or 0) + 200) <= BROADCAST_BYTES:
        shared = index.sparkSession.sparkContext.broadcast(asked.toArrow().combine_chunks())

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _Asked(*(c.combine_chunks() for c in shared.value.columns))
            for batch in batches:
                if batch.num_rows and own.names:
                    yield from own.best(*batch.columns, k)

        near = rows.mapInArrow(sent, schema)
    else:
        cells = [F.col(c) for c in ("v", "c", "s")]
        packed = lambda frame, name, by, keyed: _blocks(frame, name, [F.col(name), *cells], by, keyed)
        pairs = packed(rows, "k", "rows", True).join(packed(asked.where("c is not null"), "q", "asked", True), "g").select("rows", "asked")
        anyone = packed(asked.where("c is null"), "q", "asked", False).select("asked")
        # A stated set of questions against all rows, block by block: there is no key to join them by.
        pairs = pairs.unionByName(packed(rows, "k", "rows", False).crossJoin(anyone).select("rows", "asked"))

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found, questions in zip(batch.column(0), batch.column(1), strict=True):
                    yield from _Asked(*questions.values.flatten()).best(*found.values.flatten(), k)

        near = pairs.mapInArrow(met, schema)
    order = Window.partitionBy("q").orderBy(F.desc("s"), "k")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("k").alias(key), F.col("s").alias("score"), "rank")


@dataclass(frozen=True)
class TextIndex:
    """An inverted index: postings (key, term, tf, length and what was carried), df of each term, n_docs and mean_length; the last two by group, if any."""

    postings: DataFrame
    df: DataFrame
    totals: DataFrame


def _each_term(docs: DataFrame, keep_cols: list[str], text: str) -> DataFrame:
    """A row for each term of each document and one, without a term, for the document; texts are cut once."""
    terms = docs.select(*keep_cols, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    return terms.select(*keep_cols, F.size("terms").alias("length"), F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))


def term_counts(docs: DataFrame, key: str = "key", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, ``carry``, length, term and tf of every term of every document.

    Terms are counted within their row, in sorted runs, so nothing is shuffled; only rows that share their key are counted together.
    """
    names = [key, *carry]
    again = keep(docs.groupBy(key).count().where("count > 1").select(key))
    if again.isEmpty():
        return _row_terms(docs, names, text)
    few = F.broadcast(again) if again.count() * 64 <= BROADCAST_BYTES else again
    together = _each_term(docs.join(few, key, "left_semi"), names, text).where("term is not null").groupBy(*names, "length", "term").agg(F.count("*").alias("tf"))
    return _row_terms(docs.join(few, key, "left_anti"), names, text).unionByName(together)


def _row_terms(docs: DataFrame, names: list[str], text: str) -> DataFrame:
    """The same of rows whose keys are theirs alone."""
    terms = docs.select(*names, F.sort_array(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("terms")).withColumn("length", F.size("terms"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0))), lambda i: (i < F.col("length")) & ((i == 0) | (F.get("terms", i) != F.get("terms", i - 1))))
    runs = terms.select(*names, "length", "terms", starts.alias("starts"))
    counted = F.transform("starts", lambda s, i: F.struct(F.get("terms", s).alias("term"), (F.coalesce(F.get("starts", i + 1), F.col("length")) - s).cast("long").alias("tf")))
    return runs.select(*names, "length", F.inline(counted))


def text_index(docs: DataFrame, key: str = "key", text: str = "text", group: str | None = None, only: DataFrame | None = None, carry: tuple[str, ...] = ()) -> TextIndex:
    """The inverted index of documents. With ``only`` (term and the group column) no other terms are counted: they are gone before the shuffle.

    Counted terms are kept, so that a text is cut once for postings, document counts and totals. Every statistic is a partial
    aggregation: a term that all documents hold is not gathered anywhere.
    """
    by = [group] if group else []
    names = [key, *by, *(c for c in carry if c not in by)]
    each = _each_term(docs, names, text)
    if only is not None:
        each = each.join(only.withColumn("_asked", F.lit(True)), ["term", *by], "left").where("term is null or _asked").drop("_asked")
    counted = keep(each.groupBy(*names, "length", "term").agg(F.count("*").alias("tf")))
    postings = counted.where("term is not null")
    lengths = counted.where("term is null").groupBy(*by).agg(F.sum("tf").alias("n_docs"), F.sum(F.col("tf") * F.col("length")).alias("n_terms"))
    return TextIndex(postings, postings.groupBy("term", *by).agg(F.count("*").alias("df")), lengths.withColumn("mean_length", F.col("n_terms") / F.col("n_docs")).drop("n_terms"))


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """One list of whole numbers a row, from values in the order of their rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _asked_of_texts(docs: DataFrame, vocabulary: pa.Array, key: str, text: str) -> DataFrame:
    """key, n (rows of that key), words, and of every asked term the places in the vocabulary (``ids``), ``tfs`` and ``lengths``.

    A document's terms are counted beside it, so nothing is shuffled. Only rows whose key is not theirs alone meet: they
    are one document that stands once for each row's length.
    """
    kind = dict(docs.dtypes)[key]
    cut = docs.select(F.col(key).alias("key"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    each = cut.select("key", "terms", F.array(F.size("terms")).alias("sizes"))
    again = keep(docs.groupBy(F.col(key).alias("key")).count().where("count > 1 and key is not null").select("key"))
    if not again.isEmpty():
        same = cut.join(again, "key").groupBy("key").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.collect_list(F.size("terms")).alias("sizes"))
        each = each.join(again, "key", "left_anti").unionByName(same)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        width = max(1, len(asked))
        for batch in batches:
            keys, terms, sizes = batch.columns
            n = batch.num_rows
            place = pc.index_in(terms.flatten(), value_set=asked).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            pairs, tf = np.unique(row[place >= 0] * width + place[place >= 0], return_counts=True)
            own = sizes.flatten().to_numpy(zero_copy_only=False)
            copies = pc.list_value_length(sizes).to_numpy(zero_copy_only=False)
            first = np.cumsum(copies) - copies
            times = copies[pairs // width]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row = np.repeat(pairs // width, times)
            words = np.bincount(np.repeat(np.arange(n), copies), weights=own, minlength=n).astype(np.int64)
            lists = [_lists(v, row, n) for v in (np.repeat(pairs % width, times), np.repeat(tf, times), own[first[row] + nth])]
            yield pa.RecordBatch.from_arrays([keys, pa.array(copies, pa.int64()), pa.array(words, pa.int64()), *lists], names=["key", "n", "words", "ids", "tfs", "lengths"])

    return keep(each.mapInArrow(count, f"key {kind}, n long, words long, ids array<int>, tfs array<int>, lengths array<int>"))


def _asked_of_postings(stored: TextIndex, places: DataFrame, key: str) -> DataFrame:
    """key, and of every asked term that it holds ids, tfs and lengths; only postings of asked terms are shuffled."""
    found = stored.postings.join(F.broadcast(places), "term").groupBy(F.col(key).alias("key"))
    one = found.agg(F.collect_list(F.struct("id", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length"))).alias("p"))
    return one.select("key", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"))


def _best_documents(counted: DataFrame, names: pa.Array, asking: tuple[np.ndarray, np.ndarray, np.ndarray], mean_length: float, k: int, key: str, query: str, name_kind: str) -> DataFrame:
    """The k best documents of each question. A document is scored where it stands, and of each task only the k best of every question go on.

    ``asking``: the questions in the order of their terms, where each term's begin (and the last end), and each term's weight.
    """
    kind = dict(counted.dtypes)["key"]
    shared = counted.sparkSession.sparkContext.broadcast((names, asking))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (questions, begins, idf) = shared.value
        wide, least, pool = len(names), np.full(len(names), -np.inf), []
        step = max(1, min(SCORED_ROWS, SCORES // wide))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                keys, *lists = batch.slice(at, step).columns
                ids, tf, length = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
                part = idf[ids] * tf * (X.BM25_K1 + 1) / (tf + X.BM25_K1 * (1 - X.BM25_B + X.BM25_B * length / mean_length))
                row = np.repeat(np.arange(len(keys)), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
                # Every question that asks a document's term.
                n = begins[ids + 1] - begins[ids]
                asked = questions[np.arange(n.sum()) + np.repeat(begins[ids] - np.cumsum(n) + n, n)]
                scores = np.bincount(np.repeat(row, n) * wide + asked, weights=np.repeat(part, n), minlength=len(keys) * wide).reshape(len(keys), wide)
                rounded = np.round(scores, 9)
                row, q = np.nonzero((scores > 0) & (rounded >= least))
                new = [q, np.array(keys.to_pylist())[row], scores[row, q], rounded[row, q]]
                pool = [np.concatenate(c) for c in zip(pool, new, strict=True)] if pool else new
                order = np.lexsort((pool[1], -pool[3], pool[0]))
                q = pool[0][order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                least[q[rank == k - 1]] = pool[3][order[rank == k - 1]]
                pool = [c[order[rank < k]] for c in pool]
        if pool:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(pool[0])), pa.array(pool[1].tolist(), batch.schema.field(0).type), pa.array(pool[2]), pa.array(pool[3])], names=["q", "k", "s", "r"])

    near = counted.where("key is not null and size(ids) > 0").select("key", "ids", "tfs", "lengths").mapInArrow(best, f"q {name_kind}, k {kind}, s double, r double")
    order = Window.partitionBy("q").orderBy(F.desc("r"), "k")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("k").alias(key), F.col("s").alias("score"), "rank")


def _scored_in_place(docs: DataFrame | None, asked: DataFrame, stored: TextIndex | None, k: int, key: str, text: str, query: str) -> DataFrame:
    """``keyword_topk`` of all documents for ``asked`` (question and term), which was counted small."""
    pairs = asked.toArrow()
    terms, questions = (pairs.column(c).combine_chunks().dictionary_encode() for c in ("term", query))
    vocabulary, names = terms.dictionary, questions.dictionary
    spark = asked.sparkSession
    places = spark.createDataFrame(pa.table({"term": vocabulary, "id": pa.array(np.arange(len(vocabulary)), pa.int32())}))
    if stored:
        counted, totals = _asked_of_postings(stored, places, key), stored.totals
        df = stored.df.join(F.broadcast(places), "term").select("id", "df")
    else:
        counted = _asked_of_texts(docs, vocabulary, key, text)
        totals = counted.agg(F.sum("n").alias("n_docs"), (F.sum("words") / F.sum("n")).alias("mean_length"))
        df = counted.select(F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    # One row, and one for each asked term at most.
    totals, held = totals.first(), np.full(len(vocabulary), np.nan)
    df = df.toArrow()
    held[df.column("id").to_numpy()] = df.column("df").to_numpy()
    n = totals["n_docs"] or 0
    idf = np.nan_to_num(np.log(1 + (n - held + 0.5) / (held + 0.5)))
    at = terms.indices.to_numpy()
    asking = (questions.indices.to_numpy()[np.argsort(at, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(vocabulary)))]), idf)
    return _best_documents(counted, names, asking, totals["mean_length"] or 1.0, k, key, query, dict(asked.dtypes)[query])


def keyword_topk(docs: DataFrame | None, queries: DataFrame, k: int = X.FUSION_DEPTH, key: str = "key", text: str = "text", query: str = "question_id", group: str | None = None, belongs: Column | None = None, carry: tuple[str, ...] = (), stored: TextIndex | None = None) -> DataFrame:
    """question_id, key, score and rank of the k best documents by BM25.

    Statistics are those of the whole collection, or with ``group`` those of each group, in which case
    ``queries`` carry the group they ask and only its documents compete. ``belongs`` says, over the columns of ``queries``
    and those of the documents in ``carry``, which documents compete for a question. With ``stored`` no text is read. Ties go to the smaller key.

    Where all documents compete for questions counted small, these are sent to every task, which scores its documents in blocks and lets only the
    best k pass on; else postings are joined, and every document that shares a term with a question is a row.
    """
    by = [group] if group else []
    others = [c for c in queries.columns if c not in (query, "text", *by)] if belongs is not None else []
    asked = keep(queries.select(query, *by, *others, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")))
    fits = asked.count() * 64 <= BROADCAST_BYTES
    if fits and not by and belongs is None:
        return _scored_in_place(docs, asked, stored, k, key, text, query)
    small = F.broadcast if fits else (lambda table: table)
    terms = small(asked.select("term", *by).distinct())
    index = stored or text_index(docs, key, text, group, terms, carry)
    # At most one row for each asked term, however many documents hold it.
    df = small(index.df.join(terms, ["term", *by], "left_semi"))
    matched = index.postings.join(small(asked), ["term", *by])
    if belongs is not None:
        matched = matched.where(belongs)
    matched = matched.join(df, ["term", *by])
    # One row, or one a group; groups are left to the optimiser, which sends them everywhere if they turn out small.
    matched = matched.join(index.totals, by) if by else matched.crossJoin(F.broadcast(index.totals))
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damp = F.col("tf") + X.BM25_K1 * (1 - X.BM25_B + X.BM25_B * F.col("length") / F.col("mean_length"))
    scored = matched.groupBy(query, key).agg(F.sum(weight * F.col("tf") * (X.BM25_K1 + 1) / damp).alias("score"))
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, "score", "rank")


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = X.EXPANSION_SEEDS, key: str = "key", query: str = "question_id") -> DataFrame:
    """question_id, key, rrf and rank: each list votes 1 / (60 + rank); ties keep vector order, then keyword order."""
    v = vector_hits.select(query, key, F.col("rank").alias("v"))
    w = keyword_hits.select(query, key, F.col("rank").alias("w"))
    vote = lambda c: F.coalesce(1 / (X.RRF_K + F.col(c)), F.lit(0.0))
    both = v.join(w, [query, key], "full_outer").withColumn("rrf", vote("v") + vote("w"))
    order = Window.partitionBy(query).orderBy(F.desc("rrf"), F.asc_nulls_last("v"), F.asc_nulls_last("w"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, "rrf", "rank")


def pack_context(hits: DataFrame, chunks: DataFrame, budget: int = X.CONTEXT_TOKENS, seeds: int = X.EXPANSION_SEEDS, query: str = "question_id") -> DataFrame:
    """question_id, company, fiscal_year, page, chunk, tokens, sibling and position of what fits the budget.

    ``hits`` has question_id, company, fiscal_year, page, chunk, tokens and rank. Seeds come first, in
    rank order; then the other chunks of their pages, best page first, nearest chunk first. What does not
    fit is skipped, and smaller ones after it may still enter. Hits of several filings for one question
    are an error. The fold runs over one question's candidates: its seeds' pages.
    """
    filing = ["company", "fiscal_year"]
    top = hits.where(F.col("rank") <= seeds)
    counted = top.withColumn("filings", F.size(F.collect_set(F.struct(*filing)).over(Window.partitionBy(query))))
    top = counted.withColumn("company", F.when(F.col("filings") == 1, F.col("company")).otherwise(F.raise_error(F.lit("page context belongs to one filing"))))
    top = top.withColumn("first_seen", F.min("rank").over(Window.partitionBy(query, "page")))
    own = top.select(query, *filing, "page", "chunk", "tokens", "first_seen", F.lit(False).alias("sibling"), F.col("rank").alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3"))
    seed = top.select(query, *filing, "page", F.col("chunk").alias("seed"), "first_seen", F.col("rank").alias("seed_rank"))
    near = chunks.select(*filing, "page", "chunk", "tokens").join(F.broadcast(seed) if seed.count() * 64 <= BROADCAST_BYTES else seed, [*filing, "page"])
    distance = F.abs(F.col("chunk") - F.col("seed"))
    others = near.where(distance > 0).select(query, *filing, "page", "chunk", "tokens", "first_seen", F.lit(True).alias("sibling"), F.col("first_seen").alias("o1"), distance.alias("o2"), F.col("seed_rank").alias("o3"))
    # The first place at which a chunk stands decides: a later one could not fit where the first did not.
    place = F.struct("sibling", "o1", "o2", "o3", "chunk")
    once = own.unionByName(others).groupBy(query, *filing, "page", "chunk").agg(F.min(F.struct(place.alias("place"), "tokens", "first_seen", "sibling")).alias("c"))
    item = F.struct("c.place", "page", "chunk", "c.tokens", "c.first_seen", "c.sibling")
    listed = once.groupBy(query, *filing).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<boolean>").alias("kept"))

    def take(acc: Column, c: Column) -> Column:
        fits = acc["spent"] + c["tokens"] <= budget
        return F.struct(F.when(fits, acc["spent"] + c["tokens"]).otherwise(acc["spent"]).alias("spent"), F.concat(acc["kept"], F.array(fits)).alias("kept"))

    kept = listed.withColumn("kept", F.aggregate("items", start, take)["kept"]).select(query, *filing, F.explode_outer(F.arrays_zip("items", "kept")).alias("z")).where("z.kept")
    rows = kept.select(query, *filing, "z.items.page", "z.items.chunk", "z.items.tokens", "z.items.sibling", "z.items.first_seen")
    order = Window.partitionBy(query).orderBy("first_seen", "chunk")
    return rows.withColumn("position", F.row_number().over(order)).drop("first_seen")


def display(context: DataFrame, text: Column, query: str = "question_id") -> DataFrame:
    """Context rows in reading order (place, by page and chunk) with whether the answer ``text`` cites them and how they came in."""
    order = Window.partitionBy(query).orderBy("page", "chunk")
    how = F.when(F.col("sibling"), "same page as a hit").otherwise(F.concat(F.lit("similarity "), F.format_string("%.3f", F.col("score"))))
    return context.withColumns({"place": F.row_number().over(order), "cited": F.array_contains(T.cited_pages(text), F.col("page").cast("int")), "how": how})


def rerank(hits: DataFrame, score: Column, query: str = "question_id", key: str = "key", depth: int = X.RERANK_DEPTH) -> DataFrame:
    """The first ``depth`` hits in the order of another model's score, with both ranks."""
    order = Window.partitionBy(query).orderBy(F.desc("rerank"), "rank_before")
    return hits.where(F.col("rank") <= depth).withColumn("rerank", score).withColumnRenamed("rank", "rank_before").withColumn("rank_after", F.row_number().over(order)).select(query, key, "rerank", "rank_before", "rank_after")
