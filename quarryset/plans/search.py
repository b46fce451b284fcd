"""Queries on vectors, payloads and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryset.functions import distance, payload
from quarryset.operators import fulltext, ivf, maxsim, quantize, vectors
from quarryset.plans import planner
from quarryset.plans.register import registry
from quarryset.sources.tables import load

QUERIES, SQL, query = registry()


def _points(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _one(s: SparkSession, d: str, vec_id: int) -> list[float]:
    return [float(x) for x in load(s, d, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding]


_E = "e as (select vec_id as id, embedding::double[] as v, label from embeddings), q as (select embedding::double[] as q from embeddings where vec_id = 0)"
_COS = "round(list_cosine_similarity(v, q), 6)"


@query(f"with {_E} select id as vec_id, label, {_COS} as score from e, q order by score desc, id limit 10")
def knn_cosine(s, d):
    return vectors.knn(_points(s, d), _one(s, d, 0), 10).select(F.col("id").alias("vec_id"), "label", "score")


@query(f"with {_E} select id as vec_id, label, round(list_distance(v, q), 6) as score from e, q order by score, id limit 10")
def knn_l2(s, d):
    return vectors.knn(_points(s, d), _one(s, d, 0), 10, "l2").select(F.col("id").alias("vec_id"), "label", "score")


@query(f"with {_E} select id as vec_id, label, round(list_inner_product(v, q), 6) as score from e, q order by score desc, id limit 10")
def knn_dot(s, d):
    return vectors.knn(_points(s, d), _one(s, d, 0), 10, "dot").select(F.col("id").alias("vec_id"), "label", "score")


@query(f"with {_E} select id as vec_id, {_COS} as score from e, q where label = 3 order by score desc, id limit 10")
def knn_filtered(s, d):
    return vectors.knn(_points(s, d), _one(s, d, 0), 10, where=F.col("label") == 3).select(F.col("id").alias("vec_id"), "score")


@query(f"with {_E} select id as vec_id, {_COS} as score from e, q where {_COS} >= 0.2 order by score desc, id limit 1000")
def knn_threshold(s, d):
    return vectors.knn(_points(s, d), _one(s, d, 0), 1000, threshold=0.2).select(F.col("id").alias("vec_id"), "score")


def _batch(metric: str, expr: str, order: str):
    sql = f"""with e as (select vec_id as id, embedding::double[] as v from embeddings),
    s as (select a.id as qid, b.id, round({expr}, 6) as score from e a, e b where a.id % 20 = 0),
    r as (select *, row_number() over (partition by qid order by score {order}, id) as rank from s) select qid, id, score, rank from r where rank <= 10"""

    def run(s, d):
        p = _points(s, d)
        return vectors.knn_batch(p, p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 10, metric)

    query(sql, f"knn_batch_{metric}")(run)


_batch("cosine", "list_cosine_similarity(a.v, b.v)", "desc")
_batch("l2", "list_distance(a.v, b.v)", "")
_batch("dot", "list_inner_product(a.v, b.v)", "desc")


@query("""with e as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select a.id as qid, b.id, round(list_cosine_similarity(a.v, b.v), 6) as score from e a, e b where a.id % 20 = 0),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, score, rank from r where rank <= 5""")
def knn_join(s, d):
    p = _points(s, d)
    return vectors.knn_join(p, p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 5)


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as length from embeddings")
def normalize(s, d):
    p = _points(s, d)
    n = distance.norm(F.col("vector"))
    unit = distance.norm(distance.normalized(F.col("vector")))
    return p.filter(F.abs(unit - 1) < 1e-9).select(F.col("id").alias("vec_id"), F.round(n, 6).alias("length"))


@query("select collection, id, uid from (select collection, id, min(uid) as uid from points group by 1, 2) where collection = 'help_pages' and id > '5' order by id limit 30")
def scroll(s, d):
    p = load(s, d, "points").filter("collection = 'help_pages'").groupBy("collection", "id").agg(F.min("uid").alias("uid"))
    return vectors.scroll(p, 30, "5")


@query("""select collection, id, uid, len(vector) as n from (select distinct * from points where uid is not null) p where not exists (select 1 from upserts u where u.collection = p.collection and u.id = p.id)
union all select collection, id, arg_max(uid, seq) as uid, len(max_by(vector, seq)) as n from (select collection, id, seq, uid, coalesce(vector, []) as vector from upserts) group by 1, 2""")
def upsert(s, d):
    p = load(s, d, "points").distinct().select("collection", "id", "uid", "vector")
    u = load(s, d, "upserts").select("collection", "id", "uid", F.coalesce("vector", F.array().cast("array<float>")).alias("vector"), "seq")
    return vectors.upsert(p, u).select("collection", "id", "uid", F.when(F.col("vector").isNotNull(), F.size("vector")).cast("bigint").alias("n"))


@query("select distinct collection, id from points where not exists (select 1 from upserts u where u.collection = points.collection and u.id = points.id)")
def delete_ids(s, d):
    return vectors.delete(load(s, d, "points").select("collection", "id").distinct(), load(s, d, "upserts"))


@query("select event_id from events where not coalesce(cast(json_extract(props, '$.k') as double) = 17, false)")
def delete_filter(s, d):
    return vectors.delete(load(s, d, "events"), where=payload.matches(F.col("props"), "k", 17)).select("event_id")


@query("select name, dim, metric, coalesce(n, 0) as points from collections left join (select collection, count(distinct id) as n from points group by 1) on collection = name")
def collections(s, d):
    return vectors.collection_info(load(s, d, "points"), load(s, d, "collections"))


# ---- payload conditions

_OK = "json_valid(payload)"


@query("select distinct uid from points where case when json_valid(payload) then coalesce(json_type(payload, '$.metadata.lang') = 'VARCHAR' and json_extract_string(payload, '$.metadata.lang') = 'de', false) else false end")
def payload_match(s, d):
    return load(s, d, "points").filter(payload.matches(F.col("payload"), "metadata.lang", "de")).select("uid").distinct()


@query("select event_id from events where cast(json_extract(props, '$.k') as double) = 42")
def payload_number(s, d):
    return load(s, d, "events").filter(payload.matches(F.col("props"), "k", 42.0)).select("event_id")


@query("select distinct uid from points where case when json_valid(payload) then json_type(payload, '$.lang') is not null else false end")
def payload_present(s, d):
    return load(s, d, "points").filter(payload.present(F.col("payload"), "lang")).select("uid").distinct()


@query("select distinct uid from points where case when json_valid(payload) then coalesce(json_type(payload, '$.lang') = 'NULL', false) else false end")
def payload_null(s, d):
    return load(s, d, "points").filter(payload.matches(F.col("payload"), "lang", None)).select("uid").distinct()


@query("select event_id from events where cast(json_extract(props, '$.k') as int) in (1, 2, 3) and event_type = 'click'")
def payload_should(s, d):
    c = payload.condition(F.col("props"), should=[("k", 1), ("k", 2), ("k", 3)])
    return load(s, d, "events").filter(c & (F.col("event_type") == "click")).select("event_id")


@query("select event_id from events where cast(json_extract(props, '$.k') as int) not in (5, 6)")
def payload_must_not(s, d):
    return load(s, d, "events").filter(payload.condition(F.col("props"), must=["k"], must_not=[("k", 5), ("k", 6)])).select("event_id")


# ---- inverted lists: fixed centroids, so that SQL can say the same

_LISTS = """e as (select vec_id as id, embedding::double[] as v from embeddings), c as (select id as list_id, v as c from e where id < 8),
a as (select e.id, e.v, c.list_id, row_number() over (partition by e.id order by round(list_distance(e.v, c.c) ** 2, 9), c.list_id) as n from e, c), l as (select id, v, list_id from a where n = 1)"""


def _centroids(s, d):
    return _points(s, d).filter("id < 8").select(F.col("id").cast("int").alias("list_id"), F.col("vector").cast("array<double>").alias("centroid"))


@query(f"with {_LISTS} select id, list_id from l")
def ivf_assign(s, d):
    return ivf.assign(_points(s, d), _centroids(s, d)).select("id", F.col("list_id").cast("bigint").alias("list_id"))


@query(f"""with {_LISTS}, q as (select id as qid, v as q from e where id % 20 = 0),
p as (select qid, q, list_id from (select qid, q, list_id, row_number() over (partition by qid order by round(list_distance(q, c) ** 2, 9), list_id) as n from q, c) where n <= 3),
s as (select qid, id, round(list_cosine_similarity(v, q), 6) as score from p join l using (list_id)),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, score, rank from r where rank <= 10""")
def ivf_probe(s, d):
    p = _points(s, d)
    stored = ivf.assign(p, _centroids(s, d))
    queries = p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    return ivf.search(stored, _centroids(s, d), queries, 10, ivf.IvfConfig(lists=8, probes=3))


_RECALL = f"""with {_LISTS}, q as (select id as qid, v as q from e where id % 20 = 0),
p as (select qid, q, list_id from (select qid, q, list_id, row_number() over (partition by qid order by round(list_distance(q, c) ** 2, 9), list_id) as n from q, c) where n <= 3),
s as (select qid, id, round(list_cosine_similarity(v, q), 6) as score from p join l using (list_id)), f as (select qid, id from s qualify row_number() over (partition by qid order by score desc, id) <= 10),
a2 as (select qid, id, round(list_cosine_similarity(v, q), 6) as score from q, e), t as (select qid, id from a2 qualify row_number() over (partition by qid order by score desc, id) <= 10)"""


@query(f"{_RECALL} select t.qid, count(f.id) / count(*) as recall from t left join f on f.qid = t.qid and f.id = t.id group by t.qid")
def ivf_recall(s, d):
    """Share of the true 10 nearest that 3 of 8 lists hold, for each query."""
    p = _points(s, d)
    queries = p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    found = ivf.search(ivf.assign(p, _centroids(s, d)), _centroids(s, d), queries, 10, ivf.IvfConfig(lists=8, probes=3))
    return vectors.recall(found, vectors.knn_batch(p, queries, 10))


def _coded_ivf(codec: str):
    # all lists are read and enough candidates kept, so that codes lose nothing and exact scores decide
    @query("""with e as (select vec_id as id, embedding::double[] as v from embeddings), s as (select a.id as qid, b.id, round(list_cosine_similarity(a.v, b.v), 6) as score from e a, e b where a.id % 20 = 0),
    r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, score, rank from r where rank <= 3""", f"ivf_{codec}")
    def run(s, d):
        p = _points(s, d)
        config = ivf.IvfConfig(lists=8, probes=8, rounds=3, codec=codec)
        stored, decoder = ivf.encode(ivf.assign(p, _centroids(s, d)).select("id", "vector", "list_id"), config, 64, 8, 6)
        return ivf.search(stored, _centroids(s, d), p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 3, config, decoder, oversample=60 if codec == "pq" else 8)


_coded_ivf("sq8")
_coded_ivf("pq")


@query("""with e as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select a.id as qid, b.id, round(list_cosine_similarity(a.v, b.v), 6) as score from e a, e b where a.id % 20 = 0),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, score, rank from r where rank <= 3""")
def planned_search(s, d):
    p = _points(s, d)
    return planner.search(p, p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 3, ivf.IvfConfig(lists=8), _centroids(s, d))


# ---- codecs

_SQ = """u as (select vec_id as id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings),
r as (select i, min(x) as lo, max(x) as hi from u group by i),
k as (select id, i, x, lo, hi, cast(greatest(-127, least(127, round((x - (lo + hi) / 2) / ((hi - lo) / 254)))) as bigint) as code from u join r using (i))"""


@query(f"with {_SQ} select id, cast(sum(code * i) as bigint) as code_sum from k group by id")
def sq8_codes(s, d):
    p = _points(s, d)
    c = quantize.sq8_encode(p, quantize.sq8_train(p))
    return c.select("id", F.expr("aggregate(transform(codes, (c, i) -> c * (i + 1)), 0L, (a, x) -> a + x)").alias("code_sum"))


_WORST = "aggregate(zip_with(vector, {back}, (a, b) -> abs(cast(a as double) - b)), 0D, (m, x) -> greatest(m, x))"
_SUM = "aggregate(transform({back}, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)"


def _back(df, back):
    """What a round trip gives back, as one number a vector, and the largest error."""
    return df.select("id", F.round(F.expr(_SUM.format(back=back)), 4).alias("total"), F.round(F.expr(_WORST.format(back=back)), 6).alias("worst"))


def _sq_back(name: str, levels: int):
    half = levels // 2
    sql = _SQ.replace("254", str(levels)).replace("127", str(half))

    @query(f"with {sql} select id, round(sum(((lo + hi) / 2 + code * ((hi - lo) / {levels})) * i), 4) as total, round(max(abs(x - ((lo + hi) / 2 + code * ((hi - lo) / {levels})))), 6) as worst from k group by id", name)
    def run(s, d):
        p = _points(s, d)
        r = quantize.sq8_train(p)
        return _back(quantize.sq8_decode(quantize.sq8_encode(p, r, levels=levels), r, levels=levels), "decoded")


_sq_back("sq8_roundtrip", 254)
_sq_back("sq4_roundtrip", 14)

# a half has 11 significant bits; below 2^-14 its steps are 2^-24
_HALF = "greatest(power(2.0, floor(log2(greatest(abs({x}), 1e-30))) - 10), power(2.0, -24))"


@query(f"""with u as (select vec_id as id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), h as (select *, {_HALF.format(x='x')} as h from u)
select id, round(sum(round_even(x / h, 0) * h * i), 4) as total, round(max(abs(x - round_even(x / h, 0) * h)), 6) as worst from h group by id""")
def fp16_roundtrip(s, d):
    return _back(_points(s, d).withColumn("half", F.col("vector")).withColumn("half", quantize.fp16(F.col("half")).cast("array<double>")), "half")


_KEYED = f"with {_SQ}, q as (select generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as q from embeddings where vec_id = 7), b as (select id, q, (lo + hi) / 2 + code * ((hi - lo) / 254) as y from k join q using (i))"


@query(f"{_KEYED} select id, round(sqrt(sum((y - q) ** 2)), 6) as score from b group by id")
def sq8_l2(s, d):
    p = _points(s, d)
    r = quantize.sq8_train(p)
    return quantize.sq8_distance(quantize.sq8_encode(p, r), r, _one(s, d, 7))


@query(f"{_KEYED} select id, round(sum(y * q), 6) as score from b group by id")
def sq8_dot(s, d):
    p = _points(s, d)
    r = quantize.sq8_train(p)
    return quantize.sq8_distance(quantize.sq8_encode(p, r), r, _one(s, d, 7), "dot")


_PQ = """u as (select vec_id as id, s, embedding[s * 16 + 1 : s * 16 + 16]::double[] as part from embeddings, (select unnest([0, 1, 2, 3]) as s)),
b as (select s, id as code, part as c from u where id < 16),
a as (select u.id, u.s, b.code, row_number() over (partition by u.id, u.s order by round(list_distance(u.part, b.c) ** 2, 9), b.code) as n from u join b on u.s = b.s),
k as (select id, s, code from a where n = 1)"""


def _book(s, d):
    return _points(s, d).filter("id < 16").select(F.col("id").cast("int").alias("code"), F.expr("explode(transform(sequence(0, 3), s -> struct(s as sub, slice(cast(vector as array<double>), s * 16 + 1, 16) as centroid)))").alias("_b")).select("_b.sub", "code", "_b.centroid")


@query(f"with {_PQ} select id, cast(sum(code * power(16, s)) as bigint) as code from k group by id")
def pq_encode(s, d):
    c = quantize.pq_assign(_points(s, d), _book(s, d), 4, 64)
    return c.select("id", F.expr("aggregate(transform(codes, (c, i) -> c * power(16, i)), 0D, (a, x) -> a + x)").cast("bigint").alias("code"))


@query(f"with {_PQ}, f as (select k.id, k.s, unnest(b.c) as x, generate_subscripts(b.c, 1) as i from k join b on b.s = k.s and b.code = k.code) select id, round(sum(x * (s * 16 + i)), 4) as total from f group by id")
def pq_decode(s, d):
    book = _book(s, d)
    back = quantize.pq_decode(quantize.pq_assign(_points(s, d), book, 4, 64), book)
    return back.select("id", F.round(F.expr(_SUM.format(back="decoded")), 4).alias("total"))


@query(f"""with {_PQ}, n as (select u.s, k.code, avg(x) as x, i from (select id, s, unnest(part) as x, generate_subscripts(part, 1) as i from u) u join k on k.id = u.id and k.s = u.s group by u.s, k.code, i)
select cast(s as integer) as sub, cast(code as integer) as code, round(sum(x * i), 5) as total from n group by s, code""")
def pq_train(s, d):
    """One round from fixed first centroids, which SQL can follow."""
    book = quantize.pq_train(_points(s, d), 4, 16, 64, rounds=1)
    return book.select("sub", "code", F.round(F.expr(_SUM.format(back="centroid")), 5).alias("total"))


@query(f"with {_PQ}, q as (select s, part as q from u where id = 100), t as (select b.s, b.code, list_distance(q.q, b.c) ** 2 as d from b join q on b.s = q.s) select id, round(sum(d), 6) as score from k join t on k.s = t.s and k.code = t.code group by id order by score, id limit 10")
def pq_adc(s, d):
    book = _book(s, d)
    return quantize.pq_search(quantize.pq_assign(_points(s, d), book, 4, 64), quantize.pq_table(book, _one(s, d, 100), 4), 10)


@query(f"with {_E} select id, {_COS} as score from e, q order by score desc, id limit 3")
def two_stage(s, d):
    p, q = _points(s, d), _one(s, d, 0)
    r = quantize.sq8_train(p)
    coded = quantize.sq8_decode(quantize.sq8_encode(p, r), r)
    candidates = vectors.knn(coded, q, 15, vector="decoded")
    return ivf.two_stage(p, candidates, q, 3).select("id", "score")


# ---- late interaction: labels as documents, the first vectors as query tokens


def _patches(s, d):
    return _points(s, d).select(F.col("label").alias("doc_id"), F.col("id").alias("patch_no"), "vector")


@query("""with e as (select vec_id as id, label, embedding::double[] as v from embeddings), t as (select id as token, v as t from e where id < 4),
m as (select label as doc_id, token, max(list_inner_product(v, t)) as s from e, t group by 1, 2) select doc_id, round(sum(s), 6) as score from m group by doc_id""", "maxsim")
def maxsim_scores(s, d):
    p = _points(s, d)
    return maxsim.maxsim(_patches(s, d), p.filter("id < 4").select(F.col("id").alias("token"), "vector"))


@query(f"""with e as (select vec_id as id, label, embedding::double[] as v from embeddings), t as (select id as token, v as t from e where id < 4),
u as (select id, label, id // 32 as blk, unnest(v) as x, generate_subscripts(v, 1) as i from e), m as (select label, blk, max(abs(x)) as m from u group by 1, 2), sc as (select label, blk, round_even(m / {_HALF.format(x='m')}, 0) * {_HALF.format(x='m')} as scale from m),
c as (select id, label, i, greatest(-127, least(127, round(x / scale * 127))) * scale / 127 as y from u join sc using (label, blk)), w as (select token, unnest(t) as q, generate_subscripts(t, 1) as i from t),
s as (select label, id, token, sum(y * q) as s from c join w using (i) group by 1, 2, 3), b as (select label, token, max(s) as s from s group by 1, 2) select label as doc_id, round(sum(s), 5) as score from b group by label""")
def maxsim_sq8(s, d):
    p = _points(s, d)
    tokens = p.filter("id < 4").select(F.col("id").alias("token"), "vector")
    return maxsim.maxsim(maxsim.decode(quantize.sq8_blocks(_patches(s, d))), tokens).select("doc_id", F.round("score", 5).alias("score"))


@query("""with e as (select vec_id as id, label, embedding::double[] as v from embeddings), q as (select v as q from e where id = 0), t as (select id as token, v as t from e where id < 4),
f as (select id from e, q order by round(list_cosine_similarity(v, q), 6) desc, id limit 50),
m as (select e.id as doc_id, token, list_inner_product(v, t) as s from e join f using (id), t) select doc_id, round(sum(s), 6) as score from m group by doc_id order by score desc, doc_id limit 10 offset 2""")
def multivector_search(s, d):
    p = _points(s, d)
    docs = p.select(F.col("id").alias("doc_id"), "vector")
    tokens = p.filter("id < 4").select(F.col("id").alias("token"), "vector")
    return maxsim.search(docs, docs.withColumn("patch_no", F.lit(0)), _one(s, d, 0), tokens, 50, 10, 2)


# ---- full text (over part names and types, whose letters both engines fold alike)

_FT = """t as (select p_partkey as doc_id, 'p_name' as field, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) as term from part
union all select p_partkey as doc_id, 'p_type' as field, p_type as term from part), x as (select term, doc_id, field, count(*) as tf from t where term <> '' group by 1, 2, 3)"""


def _index(s, d):
    return fulltext.inverted(load(s, d, "part"), "p_partkey", ["p_name"], ["p_type"])


@query(f"with {_FT} select * from x")
def ft_index(s, d):
    return _index(s, d)


@query(f"with {_FT} select term, count(distinct doc_id) as df from x group by term")
def ft_df(s, d):
    return fulltext.document_frequency(_index(s, d))


@query(f"with {_FT} select doc_id from x where term = 'red' and field = 'p_name' and doc_id in (select doc_id from x where term = 'ECONOMY') and doc_id not in (select doc_id from x where term = 'widget')")
def ft_boolean(s, d):
    return fulltext.search(_index(s, d), must=["p_name:red", "ECONOMY"], must_not=["widget"])


@query(f"with {_FT} select distinct doc_id from x where term in ('ring', 'widget')")
def ft_should(s, d):
    return fulltext.search(_index(s, d), should=["ring", "widget"])


@query(f"""with {_FT}, n as (select count(*) as n from part), p as (select term, doc_id, sum(tf) as tf from x where term in ('red', 'ring', 'ECONOMY') group by 1, 2), f as (select term, count(*) as df from p group by term)
select doc_id, round(sum(tf * ln(n / df)), 6) as score from p join f using (term), n group by doc_id order by score desc, doc_id limit 20""")
def ft_tfidf(s, d):
    n = load(s, d, "part").agg(F.count(F.lit(1)).alias("n"))
    return fulltext.tfidf(_index(s, d), n, ["red", "ring", "ECONOMY"], 20)


@query("""with w as (select distinct unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) as term from part) select term, cast(levenshtein(term, 'wigdet') as integer) as distance from w where levenshtein(term, 'wigdet') <= 3""")
def ft_spelling(s, d):
    v = fulltext.document_frequency(_index(s, d).filter("field = 'p_name'"))
    return fulltext.spelled_like(v, "wigdet", 3).select("term", "distance")


@query(f"with {_FT} select doc_id, lower(lang) as lang from (select doc_id, lang from documents where lang is not null) where lower(lang) = 'de'")
def ft_tag(s, d):
    docs = load(s, d, "documents").select("doc_id", F.lower("lang").alias("lang"))
    return fulltext.search(fulltext.inverted(docs, "doc_id", [], ["lang"]), must=["lang:de"]).withColumn("lang", F.lit("de"))


@query("with u as (select unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) select cast(i as integer) as i, min(x) as lo, max(x) as hi from u group by i")
def sq8_train(s, d):
    return quantize.sq8_train(_points(s, d)).select(F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "_z")).select("i", "_z.lo", "_z.hi")


@query("select vec_id, round(list_sum(embedding::double[]), 4) as total from embeddings")
def vector_from_text(s, d):
    """Vectors written as text and read back."""
    p = _points(s, d).withColumn("t", F.array_join(F.transform("vector", lambda x: x.cast("string")), ", "))
    return p.select(F.col("id").alias("vec_id"), F.round(F.aggregate(distance.from_text(F.col("t")).cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""with e as (select vec_id as id, embedding::double[] as v from embeddings), s as (select a.id as qid, b.id, b.id % 2 as odd, round(list_cosine_similarity(a.v, b.v), 6) as score from e a, e b where a.id % 20 = 0),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, avg(case when odd = 0 then 1.0 else 0.0 end) as recall from r where rank <= 10 group by qid""")
def recall_at_k(s, d):
    p = _points(s, d)
    q = p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    return vectors.recall(vectors.knn_batch(p.filter("id % 2 = 0"), q, 10), vectors.knn_batch(p, q, 10))


@query(f"""with {_FT}, h as (select doc_id from x where term = 'red' and field = 'p_name' intersect select doc_id from x where term in ('ring', 'widget') except select doc_id from x where term = 'ECONOMY')
select doc_id, p_retailprice from h join part on p_partkey = doc_id order by p_retailprice desc, doc_id limit 15 offset 5""")
def ft_query_sorted(s, d):
    docs = load(s, d, "part")
    return fulltext.query(_index(s, d), docs, "p_partkey", "@p_name:red ring|widget -@p_type:{ECONOMY}", "p_retailprice", True, 5, 15, scores=False, content=["p_retailprice"])


@query(f"""with {_FT}, n as (select count(*) as n from part), p as (select term, doc_id, sum(tf) as tf from x where term in ('red', 'ring') group by 1, 2), f as (select term, count(*) as df from p group by term)
select doc_id, round(sum(tf * ln(n / df)), 6) as score from p join f using (term), n group by doc_id having count(*) = 2 order by score desc, doc_id limit 10 offset 2""")
def ft_query_scored(s, d):
    return fulltext.query(_index(s, d), load(s, d, "part"), "p_partkey", "red ring", offset=2, count=10)


@query("select * from (values ('red'), ('crimson'), ('blue')) t(term)")
def ft_synonyms(s, d):
    groups = s.createDataFrame([("red", 1), ("crimson", 1), ("blue", 2), ("azure", 3)], "term string, group_id int")
    asked = s.createDataFrame([("crimson",), ("blue",)], "term string")
    return fulltext.with_synonyms(asked, groups)


@query("select name, dim, metric, m, ef_construction from collections union all select 'fresh', 32, 'l2', 16, 200")
def collection_create(s, d):
    c = load(s, d, "collections")
    return vectors.create_collection(vectors.create_collection(c, "fresh", 32, "l2"), "help_pages", 7)


@query("select name, 0 as points from collections where name <> 'help_pages' union all select collection as name, count(*) as points from points where collection <> 'help_pages' group by 1")
def collection_drop(s, d):
    c, p = vectors.drop_collection(load(s, d, "collections"), load(s, d, "points"), "help_pages")
    return c.select("name", F.lit(0).cast("bigint").alias("points")).unionByName(p.groupBy(F.col("collection").alias("name")).agg(F.count(F.lit(1)).alias("points")))


@query("select 'help_pages' as name, true as found union all select 'none', false")
def collection_exists(s, d):
    return vectors.collection_exists(load(s, d, "collections"), ["help_pages", "none"])


@query("select distinct collection, id, payload from points p where exists (select 1 from upserts u where u.collection = p.collection and u.id = p.id)")
def points_get(s, d):
    return vectors.get_points(load(s, d, "points"), load(s, d, "upserts")).distinct()
