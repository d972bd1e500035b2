"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import ann, bpe, collocations, exact_topk, language_id, packing, piece_words, quality, simhash, simplex_clusters, token_files, url_filter, word_lm
from seriesmill.session import scratch_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Scores from which a text passes as good.
QUALITY_BAR = 0.7
#: Tokenizer file of the token queries.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Model of pieces for marked words.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Rules for pages: verdict, host and path.
URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Rows of an Arrow batch: they hold whole texts, and a worker has several copies of a batch at times.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small, in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """Fold of an id: crc32 of its text; a null id counts as an empty text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds



def simplex_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds of op13, one after the other."""
    steps = [
        f"""v as materialized (
            select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
            from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), c0 as materialized (
            select row_number() over (order by sha256('3:' || vec_id) nulls last, e) - 1 as cluster, e from v
            order by cluster limit {k}
        )"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} as materialized (
            select r, vec_id, v.e, min(d) as distance, arg_min(cluster, (d, cluster)) as cluster
            from (
                select v.*, c.cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d
                from v cross join c{n} c
            ) v group by all
        )""")
        if n < rounds:
            steps.append(f"""s{n} as (
                select cluster, place, sum(e[place])::bigint as total, count(*) as n
                from a{n} cross join range(1, 65) t(place) group by all
            ), c{n + 1} as materialized (
                select c.cluster, coalesce(m.e, c.e) as e from c{n} c left join (
                    select cluster, list((total - ((total % n) + n) % n) // n order by place) as e from s{n} group by cluster
                ) m on m.cluster = c.cluster
            )""")
    return f"""with {", ".join(steps)}
        select vec_id, cast(a.cluster as integer) as cluster, cast(distance as bigint) as distance,
            cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia,
            cast(sum(distance) over () as bigint) as inertia,
            sha256(array_to_string(c.e, ',')) as centroid_sha256
        from a{rounds} a join c{rounds} c on c.cluster = a.cluster"""


@query("op1_language_id")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language_id.fit(docs, where=fold("doc_id", 3) != 1)
    ready = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    return language_id.predict(ready, model, keep=["doc_id", "held_out"])


@query("op4_quality")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"), where=fold("doc_id", 4) != 2)
    ready = docs.withColumn("held_out", fold("doc_id", 4) == 2)
    scored = quality.score(ready, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_BAR).cast("int"))


@query("op2_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


@query("op3_simhash")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op5_ann")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_masked_lm")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return word_lm.score(table(spark, sf, "documents"))


@query("op7_bpe")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), TOKENIZER)


@query("op8_token_files")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_table(spark, "token-files")
    token_files.write(table(spark, sf, "documents"), path, TOKENIZER)
    return token_files.read(spark.read.parquet(path))


@query("op9_url_filter")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES)


@query(
    "op10_exact_topk",
    """
    with v as (
        select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
        from embeddings
        where embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
        select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
        from v q join v c on q.vec_id <> c.vec_id
        where q.vec_id % 50 = 0
    ), ranked as (
        select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
    )
    select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
    """,
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op13_simplex_clusters", simplex_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return simplex_clusters.cluster(table(spark, sf, "embeddings"))


@query(
    "op11_collocations",
    r"""
    with d as (
        select coalesce(lang, 'und') as lang,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
        from documents
    ), pieces as (
        select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from d
    ), w as materialized (
        select lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') as w from pieces
    ), n as (
        select lang, sum(len(w))::bigint as n from w group by lang
    ), f as materialized (
        select lang, m, phrase, count(*) as f from (
            select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase
            from w, range(1, 6) s(m), range(1, len(w) - m + 2) t(i)
        ) group by all having count(*) >= 100
    ), c as materialized (
        select *, string_split(phrase, ' ') as words from f where m >= 2
    ), inside as (
        select distinct lang, array_to_string(words[i:i + k - 1], ' ') as phrase, f
        from c, range(2, m) s(k), range(1, m - k + 2) t(i)
    ), cuts as (
        select c.lang, c.phrase, c.f as a, l.f as l, r.f as r, n, k,
            ((1000::hugeint * c.f * n) // (l.f::hugeint * r.f))::bigint as score
        from c join n using (lang) cross join range(1, 5) s(k)
            join f l on l.lang = c.lang and l.m = k and l.phrase = array_to_string(words[1:k], ' ')
            join f r on r.lang = c.lang and r.m = c.m - k and r.phrase = array_to_string(words[k + 1:], ' ')
        where k < c.m and not exists (
            select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.f >= 100 * c.f
        )
    ), best as (
        select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
    )
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
    from best qualify rank <= 2000
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query("op12_piece_words")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return piece_words.round_trip(table(spark, sf, "documents"), PIECES)
