"""A batch of questions to cited answers: rewrite, search, widen, gate, generate, guard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import models
from vellumgrid.functions import text as T
from vellumgrid.operators import guard
from vellumgrid.operators import search as S
from vellumgrid.sources.tables import keep

#: Filings up to which a scan is pruned to them by name.
MAX_PRUNED = 1000
CHUNK = ("company", "fiscal_year", "page", "chunk")


def _key(row: DataFrame) -> DataFrame:
    return row.withColumn("key", F.concat_ws("|", *[F.col(c).cast("string") for c in CHUNK]))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rewrite(questions: DataFrame, make: Callable[[], models.Embedder], dim: int, expand: bool = True) -> DataFrame:
    """Adds the texts that rank and gate, their vectors, the keywords and the scope.

    The vector that ranks is of the neutral question, the one that scores and gates of the question as asked.
    """
    asked, company = F.col("question"), F.col("company")
    ranks = T.ranking_query(asked, company) if expand else T.without_company(asked, company)
    gates = T.expand_fiscal_years(asked) if expand else asked
    instruct = lambda c: F.concat(F.lit(models.QUERY_INSTRUCTION), c)
    return questions.withColumns({"scope_asked": T.requested_scope(asked), "keywords": T.keyword_query(asked, company)}).withColumns({"rank_vector": models.embed(instruct(ranks), make, dim), "gate_vector": models.embed(instruct(gates), make, dim)})


def _asked_filings(index: DataFrame, stored: S.TextIndex | None, asked: DataFrame) -> tuple[DataFrame, S.TextIndex | None]:
    """Rows and postings of the asked filings alone, where those are few and every question names one; statistics stay the collection's."""
    of = [r[0] for r in asked.select("of").distinct().limit(MAX_PRUNED + 1).collect()]
    if stored is None or None in of or len(of) > MAX_PRUNED:
        return index, stored
    return index.where(F.col("company").isin(of)), S.TextIndex(stored.postings.where(F.col("company").isin(of)), stored.df, stored.totals)


def search(index: DataFrame, questions: DataFrame, make: Callable[[], models.Embedder], dim: int, k: int = X.DEFAULT_K, expand: bool = True, hybrid: bool = True, stored: S.TextIndex | None = None) -> DataFrame:
    """question_id, the chunk's columns, rrf, score and rank of the k best chunks of each question's filing and scope.

    ``questions``: question_id, question, company (null: all). ``index`` as written by ``sources.index``, ``stored`` its
    text index if it has one. Questions are rewritten and embedded once; a question meets the rows of its own filing only, and if
    all name one, no other filing's files are read.
    """
    asked = keep(rewrite(questions, make, dim, expand).select("question_id", F.col("company").alias("of"), "scope_asked", "keywords", "rank_vector", "gate_vector"))
    index, stored = _asked_filings(index, stored, asked)
    rows = _key(index)
    near = asked.select("question_id", F.col("rank_vector").alias("vector"), "of", "scope_asked")
    vector = S.vector_topk(rows, near, company="of", scope="scope_asked")
    if hybrid:
        words = asked.select("question_id", F.col("keywords").alias("text"), "of", "scope_asked")
        # Statistics are the collection's; the filing and scope only decide who competes.
        fits = (F.col("of").isNull() | (F.col("company") == F.col("of"))) & (F.col("scope_asked").isNull() | F.col("scope").isin("unstated", "mixed") | (F.col("scope") == F.col("scope_asked")))
        keyword = S.keyword_topk(rows, words, belongs=fits, carry=("company", "scope"), stored=stored)
    else:
        keyword = vector.limit(0)
    fused = S.fuse(vector, keyword, k=k)
    found = fused.join(rows, "key").join(asked.select("question_id", "gate_vector"), "question_id")
    return found.select("question_id", *CHUNK, "scope", "tokens", "text", "rrf", dot("vector", "gate_vector").alias("score"), "rank")


def ask(index: DataFrame, questions: DataFrame, make_embedder: Callable[[], models.Embedder], dim: int, make_generator: Callable[[], models.Generator], floor: float = X.MIN_SIMILARITY, widen: bool = True, stored: S.TextIndex | None = None) -> DataFrame:
    """One verdict for each question; only questions above the floor reach the generator. ``widen`` adds the hits' page siblings."""
    hits = search(index, questions, make_embedder, dim, k=max(X.DEFAULT_K, X.EXPANSION_SEEDS), stored=stored)
    hits = keep(hits)
    context = S.pack_context(hits, index) if widen else hits.select("question_id", *CHUNK, "tokens", F.lit(False).alias("sibling"), F.col("rank").alias("position"))
    texts = context.join(index.select(*CHUNK, "scope", "text"), list(CHUNK))
    worth = guard.needs_generation(questions, hits, floor)
    prompts = guard.prompts(texts).join(worth.select("question_id", "question"), "question_id")
    raw = questions.select("question_id").join(models.generate(prompts, make_generator), "question_id", "left")
    return guard.guarded_answers(raw, hits.select("question_id", "score"), texts.select("question_id", "page", "text"), floor)
