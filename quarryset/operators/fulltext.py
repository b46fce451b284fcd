"""Full text: an inverted index as a table, boolean queries, and tf-idf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits and of other letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def inverted(docs: DataFrame, doc: str, text_fields: list[str], tag_fields: list[str] = ()) -> DataFrame:
    """(term, doc_id, field, tf). Text is split into tokens, a tag is one term as it stands."""
    out = None
    for f in [*text_fields, *tag_fields]:
        terms = tokens(F.col(f)) if f in text_fields else F.array(F.col(f))
        part = docs.select(F.col(doc).alias("doc_id"), F.lit(f).alias("field"), F.explode(terms).alias("term")).filter("term is not null")
        part = part.groupBy("term", "doc_id", "field").agg(F.count(F.lit(1)).alias("tf"))
        out = part if out is None else out.unionByName(part)
    return out


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))


def search(index: DataFrame, must=(), should=(), must_not=()) -> DataFrame:
    """(doc_id) by terms, each `term` or `field:term`, in one pass over the postings of the terms."""
    every = [*must, *should, *must_not]

    def hit(q: str) -> Column:
        field, _, term = q.rpartition(":")
        return (F.col("term") == term) & (F.col("field") == field if field else F.lit(True))

    any_term = F.col("term").isin([q.rpartition(":")[2] for q in every])
    flags = index.filter(any_term).groupBy("doc_id").agg(*[F.max(hit(q)).alias(f"_{i}") for i, q in enumerate(every)])
    ok = F.lit(True)
    for i in range(len(must)):
        ok = ok & F.col(f"_{i}")
    if should:
        some = F.lit(False)
        for i in range(len(must), len(must) + len(should)):
            some = some | F.col(f"_{i}")
        ok = ok & some
    for i in range(len(must) + len(should), len(every)):
        ok = ok & ~F.col(f"_{i}")
    return flags.filter(ok).select("doc_id")


def tfidf(index: DataFrame, n_docs: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(doc_id, score) of the k best documents: sum of tf * ln(N / df). `n_docs` has one row `n`."""
    post = index.filter(F.col("term").isin(terms)).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = post.join(F.broadcast(df), "term").crossJoin(F.broadcast(n_docs.select("n")))
    out = scored.groupBy("doc_id").agg(F.sum(F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("_s"))
    return out.select("doc_id", F.round("_s", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def with_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Terms and all terms of their synonym groups (term, group_id)."""
    groups = terms.join(synonyms, "term").select("group_id").distinct()
    return terms.select("term").unionByName(synonyms.join(groups, "group_id").select("term")).distinct()


def spelled_like(vocabulary: DataFrame, word: str, distance: int) -> DataFrame:
    """Known terms within an edit distance of a word, nearest and most frequent first."""
    d = F.levenshtein(F.col("term"), F.lit(word), distance)
    return vocabulary.withColumn("distance", d).filter("distance >= 0").orderBy("distance", F.desc("df"), "term")


def parse(text: str) -> tuple[list[str], list[str], list[str]]:
    """(must, should, must_not) of a query text.

    Terms separated by blanks must all occur; `a|b` means one of them; `-a` must not occur;
    `@field:a` and `@field:{tag}` bind a term to a field. Terms are folded as texts are, tags stay
    as they stand. `*` alone means every document and gives no terms.
    """
    must, should, must_not = [], [], []
    for word in text.split():
        if word == "*":
            continue
        negative, word = word.startswith("-"), word.lstrip("-")
        field = ""
        if word.startswith("@") and ":" in word:
            field, _, word = word[1:].partition(":")
        tag = word.startswith("{") and word.endswith("}")
        parts = [p for p in (word[1:-1] if tag else word.strip("()")).split("|") if p]
        terms = [(f"{field}:" if field else "") + (p if tag else p.lower()) for p in parts]
        (must_not if negative else must if len(terms) == 1 else should).extend(terms)
    return must, should, must_not


def query(index: DataFrame, docs: DataFrame, doc: str, text: str, sort_by: str | None = None, descending: bool = False, offset: int = 0, count: int = 10, scores: bool = True, content: list[str] | None = None) -> DataFrame:
    """A page of the documents that meet a query text (`parse`).

    Ordered by a column of `docs` (nulls last) or, without one, by tf-idf of the query's terms, then
    by id. `scores` adds `score`; `content` names the columns of `docs` to return (None: the id only).
    An empty query meets every document.
    """
    must, should, must_not = parse(text)
    hits = search(index, must, should, must_not) if must or should else docs.select(F.col(doc).alias("doc_id")).distinct()
    if must_not and not (must or should):
        hits = hits.join(search(index, should=must_not), "doc_id", "left_anti")
    wanted = [t.rpartition(":")[2] for t in [*must, *should]]
    n = docs.agg(F.count_distinct(doc).alias("n"))  # one row
    post = index.filter(F.col("term").isin(wanted)).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row for each term of the query
    score = post.join(F.broadcast(df), "term").crossJoin(F.broadcast(n)).groupBy("doc_id").agg(F.round(F.sum(F.col("tf") * F.log(F.col("n") / F.col("df"))), 6).alias("score"))
    out = hits.join(score, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    extra = [c for c in dict.fromkeys([*(content or []), *([sort_by] if sort_by else [])])]
    if extra:
        out = out.join(docs.select(F.col(doc).alias("doc_id"), *[F.col(c).alias(f"_{c}") for c in extra]), "doc_id")
    first = (F.desc_nulls_last if descending else F.asc_nulls_last)(f"_{sort_by}") if sort_by else F.desc("score")
    page = out.orderBy(first, "doc_id").offset(offset).limit(count)
    return page.select("doc_id", *(["score"] if scores else []), *[F.col(f"_{c}").alias(c) for c in (content or [])])
