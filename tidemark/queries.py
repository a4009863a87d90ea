"""Registered queries of the library's own operators, and their SQL. Each runs over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import metrics, tokens
from .functions.similarity import number
from .operators import active, evaluate, extract, features, matchers, resolution, simjoin
from .operators.graph import connected_components
from .operators.pipeline import run_pipeline
from .operators.sample import WorkingSet, consistent
from .plans.scratch import new_path
from .plans.ship import ship
from .session import Session
from .sources import catalog
from .sources.loaders import as_json, coerce, read_csv, read_table, read_text, write_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Row key of lineitem: no shorter one is unique.
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.select("group", F.round("agg", digits).alias("agg"), F.round("se", digits).alias("se"))


def _bucket_sql(key: str, n: int) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % {n}"


# ---------------------------------------------------------------- estimators


def _lines(spark: SparkSession, sf_dir: str) -> Session:
    session = Session(spark)
    session.sample(table(spark, sf_dir, "lineitem"), "lines", 0.25, key="l_orderkey", row_key=LINE_KEY, unique=True)
    return session


_S = f"WITH s AS (SELECT *, count(*) OVER ()::DOUBLE AS k FROM lineitem WHERE {_bucket_sql('l_orderkey', 4)} = 0)"


def _se_sql(ratio: str) -> str:
    """Standard error of a scaled-up sum of x, from k."""
    n, c = f"(any_value(k) / {ratio})", "sum(CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END)"
    p, m = f"({c} / any_value(k))", f"(sum(x) / nullif({c}, 0))"
    return f"coalesce(sqrt(({p} * (1 - {p}) * {n} * {n} * {m} * {m} + {n} * {n} * var_samp(x)) / any_value(k)), 0)"


def _raw_sql(source: str, x: str, group: str, ratio: str = "0.25", avg: bool = False) -> str:
    agg, se = ("avg(x)", "coalesce(sqrt(var_samp(x) / any_value(k)), 0)") if avg else (f"sum(x) / {ratio}", _se_sql(ratio))
    return f'SELECT g AS "group", round({agg}, 3) AS agg, round({se}, 3) AS se FROM (SELECT {x} AS x, k, {group} AS g FROM {source}) GROUP BY g'


@query(f"{_S} {_raw_sql('s', 'CASE WHEN l_quantity > 10 THEN l_extendedprice ELSE 0 END', 'l_returnflag')}")
def raw_sum(spark, sf_dir):
    return _rounded(_lines(spark, sf_dir).sql("selectrawsc sum(l_extendedprice) from lines where l_quantity > 10 group by l_returnflag"))


@query(f"{_S} {_raw_sql('s', 'CASE WHEN l_discount < 0.05 THEN l_extendedprice * (1 - l_discount) ELSE 0 END', 'l_linestatus', avg=True)}")
def raw_avg(spark, sf_dir):
    return _rounded(_lines(spark, sf_dir).sql("SELECTRAWSC avg(l_extendedprice * (1 - l_discount)) FROM lines WHERE l_discount < 0.05 GROUP BY l_linestatus;"))


@query(f"{_S} {_raw_sql('s', 'CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END', 'l_returnflag')}")
def raw_count(spark, sf_dir):
    return _rounded(_lines(spark, sf_dir).sql("selectrawsc count(1) from lines where l_tax > 0.04 group by l_returnflag"))


_NO_GROUP = "'1'"


@query(f"{_S} {_raw_sql('s', 'l_quantity', _NO_GROUP)}")
def raw_sum_no_group(spark, sf_dir):
    return _rounded(_lines(spark, sf_dir).sql("selectrawsc sum(l_quantity) from lines"))


@query(f"""{_S}, o AS (SELECT * FROM orders WHERE {_bucket_sql('o_orderkey', 1)} = 0),
           j AS (SELECT s.*, o.o_orderstatus, o.o_totalprice FROM s JOIN o ON l_orderkey = o_orderkey), q AS (SELECT * EXCLUDE k, count(*) OVER ()::DOUBLE AS k FROM j)
           {_raw_sql('q', 'CASE WHEN o_totalprice > 100000 THEN l_extendedprice ELSE 0 END', 'o_orderstatus')}""")
def raw_join_sum(spark, sf_dir):
    session = _lines(spark, sf_dir)
    session.sample(table(spark, sf_dir, "orders"), "orders_s", row_key=["o_orderkey"], unique=True)
    return _rounded(session.sql("selectrawsc sum(l_extendedprice) from lines join orders_s on lines.l_orderkey = orders_s.o_orderkey where o_totalprice > 100000 group by o_orderstatus"))


@query("""WITH d AS (SELECT *, count(*) OVER (PARTITION BY text) AS dup FROM documents), s AS (SELECT *, count(*) OVER ()::DOUBLE AS k FROM d)
          SELECT g AS "group", round(sum(x), 3) AS agg, round(""" + _se_sql("1.0") + """, 3) AS se FROM (SELECT n_chars::DOUBLE / dup AS x, k, lang AS g FROM s) GROUP BY g""")
def raw_sum_weighted(spark, sf_dir):
    """Each document counts by its share of its exact copies."""
    docs = table(spark, sf_dir, "documents")
    ws = WorkingSet.create(docs, row_key=["doc_id"], unique=True)
    h = F.md5("text")
    dup = ws.clean.groupBy(h.alias("h")).agg(F.count("*").alias("dup"))
    ws.update_dup(ws.clean.select("hash", h.alias("h")).join(dup, "h").select("hash", "dup"))
    return _rounded(ws.aqp("sum", "n_chars", group="lang"))


def _dirty_lines(spark: SparkSession, sf_dir: str) -> WorkingSet:
    """Prices of every 50th order came in ten times too high; the clean sample has them right."""
    wrong = F.col("l_orderkey") % 50 == 0
    lines = table(spark, sf_dir, "lineitem")
    ws = WorkingSet.create(lines.withColumn("price", F.when(wrong, F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice"))), "lines", 0.25, "l_orderkey", row_key=LINE_KEY)
    return ws.replace(ws.clean.withColumn("price", F.col("l_extendedprice")))


_D = f"""WITH s AS (SELECT *, l_extendedprice AS c, CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS d,
                    count(*) OVER ()::DOUBLE AS k FROM lineitem WHERE {_bucket_sql('l_orderkey', 4)} = 0)"""


@query(f"{_D} {_raw_sql('s', 'CASE WHEN d > 30000 THEN d ELSE 0 END - CASE WHEN c > 30000 THEN c ELSE 0 END', 'l_returnflag')}")
def nsc_sum(spark, sf_dir):
    return _rounded(_dirty_lines(spark, sf_dir).query("selectnsc sum(price) from $t where price > 30000 group by l_returnflag"))


@query(f"{_D}, q AS (SELECT * FROM s WHERE c > 30000) {_raw_sql('q', 'd - c', 'l_returnflag', avg=True)}")
def nsc_avg(spark, sf_dir):
    return _rounded(_dirty_lines(spark, sf_dir).query("selectnsc avg(price) from $t where price > 30000 group by l_returnflag"))


_COUNTS = "sum(CASE WHEN c > 30000 THEN 1.0 ELSE 0 END) / 0.25 - sum(CASE WHEN d > 30000 THEN 1.0 ELSE 0 END) / 0.25"


@query(f"""{_D} SELECT g AS "group", round(a, 3) AS agg, round(n * sqrt(greatest(0, (1 - a / n) * (a / n))) / sqrt(k), 3) AS se
           FROM (SELECT l_returnflag AS g, {_COUNTS} AS a, any_value(k) AS k, any_value(k) / 0.25 AS n FROM s GROUP BY l_returnflag)""")
def nsc_count(spark, sf_dir):
    return _rounded(_dirty_lines(spark, sf_dir).query("selectnsc count(1) from $t where price > 30000 group by l_returnflag"))


@query(f"""{_D}, j AS (SELECT s.*, o_orderpriority FROM s LEFT JOIN orders ON l_orderkey = o_orderkey)
           {_raw_sql('j', 'd - c', 'o_orderpriority')}""")
def nsc_join_sum(spark, sf_dir):
    session, ws = Session(spark), _dirty_lines(spark, sf_dir)
    session.sets["lines"] = ws
    session.sample(table(spark, sf_dir, "orders"), "orders_s", row_key=["o_orderkey"], unique=True)
    return _rounded(session.sql("selectnsc sum(price) from lines join orders_s on lines.l_orderkey = orders_s.o_orderkey group by o_orderpriority"))


@query(f"""{_D}, f AS (SELECT l_returnflag AS g, sum(CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END) AS full_ FROM lineitem GROUP BY 1),
           e AS (SELECT g, sum(x) / 0.25 AS a, {_se_sql('0.25')} AS se FROM (SELECT l_returnflag AS g, d - c AS x, k FROM s) GROUP BY g)
           SELECT g AS "group", round(full_ - coalesce(a, 0), 3) AS agg, round(coalesce(se, 0), 3) AS se FROM f LEFT JOIN e USING (g)""")
def corrected_sum(spark, sf_dir):
    return _rounded(_dirty_lines(spark, sf_dir).aqp("sum", "price", group="l_returnflag", mode="corrected"))


# ---------------------------------------------------------------- samples and tables


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE {_bucket_sql('o_custkey', 3)} = 0")
def consistent_sample(spark, sf_dir):
    return consistent(table(spark, sf_dir, "orders"), "o_custkey", 1 / 3)[0].select("o_orderkey", "o_custkey")


def _customers(spark: SparkSession, sf_dir: str) -> WorkingSet:
    return WorkingSet.create(table(spark, sf_dir, "customer"), "customers", row_key=["c_custkey"], unique=True)


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, 1 AS dup FROM customer")
def keyed_update(spark, sf_dir):
    ws = _customers(spark, sf_dir)
    ws.update_attr("c_acctbal", ws.attr("c_acctbal", "c_acctbal < 0").select("hash", F.lit(0.0).alias("value")), missing="keep")
    return ws.clean.select("c_custkey", "c_mktsegment", "c_acctbal", "dup")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_name END AS c_name FROM customer")
def keyed_update_null(spark, sf_dir):
    ws = _customers(spark, sf_dir)
    ws.update_attr("c_name", ws.attr("c_name", "c_nationkey < 5").withColumnRenamed("c_name", "value"))
    return ws.clean.select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 4 ELSE 1 END AS dup FROM customer")
def dup_update(spark, sf_dir):
    ws = _customers(spark, sf_dir)
    ws.update_dup(ws.attr("c_name", "c_nationkey = 3").select("hash", F.lit(4).alias("dup")))
    return ws.clean.select("c_custkey", "dup")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def keep_filter(spark, sf_dir):
    ws = _customers(spark, sf_dir)
    buyers = ws.clean.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("hash")
    return ws.keep(buyers).clean.select("c_custkey", "c_name")


@query("SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segments, max(c_acctbal) AS top FROM customer")
def reset_sample(spark, sf_dir):
    ws = _customers(spark, sf_dir)
    ws.keep(ws.attr("c_name", "c_nationkey = 1")).reset()
    return ws.query("select count(*) as n, count(distinct c_mktsegment) as segments, max(c_acctbal) as top from $t")


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def rebase_sample(spark, sf_dir):
    ws = _customers(spark, sf_dir)
    ws.replace(ws.clean.withColumn("c_name", F.upper("c_name"))).rebase().replace(ws.clean.limit(0)).reset()
    return ws.clean.select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer")
def write_back(spark, sf_dir):
    ws = _customers(spark, sf_dir)
    return ws.replace(ws.clean.withColumn("c_mktsegment", F.lower("c_mktsegment"))).write_back()


@query("SELECT c_nationkey, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY c_nationkey")
def working_set_view(spark, sf_dir):
    view = _customers(spark, sf_dir).view("select distinct c_nationkey, c_mktsegment from $t")
    return view.query("select c_nationkey, count(*) as n from $t group by c_nationkey")


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def json_sink(spark, sf_dir):
    return as_json(table(spark, sf_dir, "region"))


# ---------------------------------------------------------------- tokens and similarities


def _token_digest(tokenizer):
    def run(spark, sf_dir):
        t = tokenizer(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, "|")).alias("digest"))

    return run


def _token_sql(tokens_: str) -> str:
    return f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, list_filter({tokens_}, lambda x: x <> '') AS t FROM documents)"


for _name, _tokenizer, _sql in (
    ("tokens_word", tokens.word(), "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')"),
    ("tokens_delimiter", tokens.delimiter(), r"string_split_regex(coalesce(text, ''), '[.,?!\t ]+')"),
    ("tokens_whole", tokens.whole(), "[coalesce(text, '')]"),
    ("tokens_white_space", tokens.white_space(), r"string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+')"),
    ("tokens_gram", tokens.gram(3), "list_transform(range(1, greatest(length(coalesce(text, '')) - 2, 1) + 1), lambda i: substr(coalesce(text, ''), i, 3))"),
    ("tokens_white_space_punctuation", tokens.white_space_punctuation(), r"""string_split_regex(coalesce(text, ''), '[.,!?:;''"\- \t\n\x0B\f\r]+')"""),
):
    QUERIES[_name], SQL[_name] = _token_digest(_tokenizer), _token_sql(_sql)


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) AS token FROM documents)
          SELECT token, count(*) AS df, round(log10((SELECT count(*) FROM documents) / count(*)), 6) AS weight FROM t GROUP BY token""")
def token_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(tokens.word()(F.col("text")).alias("tokens"))
    return simjoin.token_weights(rows).select("token", "df", F.round("weight", 6).alias("weight"))


_METRICS = ["JaccardSimilarity", "DiceSimilarity", "CosineSimilarity", "OverlapSimilarity", "Levenshtein", "Jaro", "JaroWinkler"]


@query("""WITH p AS (SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key, replace(a.n_name, '_', ' ') AS a, replace(b.n_name, '_', ' ') AS b FROM nation a, nation b),
               t AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y, jaro_similarity(a, b) AS j,
                            CASE WHEN left(a, 4) = left(b, 4) THEN 4 WHEN left(a, 3) = left(b, 3) THEN 3 ELSE 0 END AS prefix FROM p),
               m AS (SELECT *, len(list_intersect(x, y)) AS met FROM t)
          SELECT a_key, b_key, round(met / (len(x) + len(y) - met), 6) AS "JaccardSimilarity", round(2 * met / (len(x) + len(y)), 6) AS "DiceSimilarity",
                 round(met / sqrt(len(x) * len(y)), 6) AS "CosineSimilarity", met::DOUBLE AS "OverlapSimilarity", levenshtein(a, b)::DOUBLE AS "Levenshtein",
                 round(j, 6) AS "Jaro", round(j + prefix * 0.1 * (1 - j), 6) AS "JaroWinkler" FROM m""")
def string_metrics(spark, sf_dir):
    """Metrics of every two nations' names: 25 rows, whatever the scale."""
    ship(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"))
    pairs = F.broadcast(n.select(F.col("n_nationkey").alias("a_key"), F.col("name").alias("a"))).crossJoin(n.select(F.col("n_nationkey").alias("b_key"), F.col("name").alias("b")))
    return pairs.select("a_key", "b_key", *[F.round(metrics.string_metric(m, F.col("a"), F.col("b")), 6).alias(m) for m in _METRICS])


@query()
def string_metrics_all(spark, sf_dir):
    """All 23 named metrics of the supplier names with a fixed one; SQL and tests hold thirteen of them."""
    ship(spark)
    s = table(spark, sf_dir, "supplier").withColumn("other", F.lit("Suplier #10"))
    names = [*metrics.BUILT_IN, "Levenshtein", *metrics.PYTHON]
    return s.select("s_suppkey", *[F.round(metrics.string_metric(m, F.col("s_name"), F.col("other")), 6).alias(m) for m in names])


# ---------------------------------------------------------------- similarity joins

_BAGS = """t AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') AS l FROM documents),
           b AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(l) AS token FROM t) GROUP BY ALL),
           f AS (SELECT token, count(*) AS df, {w} AS w FROM b GROUP BY token),
           s AS (SELECT id, sum(n * w) AS total FROM b JOIN f USING (token) GROUP BY id),
           m AS (SELECT x.id AS id_a, y.id AS id_b, sum(least(x.n, y.n) * w) AS met FROM b x JOIN b y ON x.token = y.token AND x.id < y.id JOIN f ON x.token = f.token GROUP BY ALL),
           v AS (SELECT id_a, id_b, met, p.total AS p, q.total AS q FROM m JOIN s p ON p.id = id_a JOIN s q ON q.id = id_b)"""
_VALUE = {"jaccard": ("met / (p + q - met)", 0.7, 1e-6), "dice": ("2 * met / (p + q)", 0.8, 0), "cosine": ("met / sqrt(p * q)", 0.8, 0), "overlap": ("met", 900, 0)}


def _join_query(metric: str, weighted: bool):
    threshold = _VALUE[metric][1]

    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        out = simjoin.prefix(docs, id="doc_id", cols=["text"], similarity_name=metric, threshold=threshold, weighted=weighted)
        return out.select("id_a", "id_b", F.round("sim", 4).alias("sim"))

    return run


for _metric, (_value, _t, _tolerance) in _VALUE.items():
    for _weighted in (False, True):
        _w = "log10((SELECT count(*) FROM documents) / count(*))" if _weighted else "1.0::DOUBLE"
        _name = f"prefix_join_{_metric}" + "_weighted" * _weighted
        QUERIES[_name] = _join_query(_metric, _weighted)
        SQL[_name] = f"WITH {_BAGS.format(w=_w)} SELECT id_a, id_b, round({_value}, 4) AS sim FROM v WHERE {_value} + {_tolerance} >= {_t}"


@query("""WITH t AS (SELECT item_id AS id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS l, regexp_extract_all(text, '[A-Za-z0-9_]+') AS bag FROM benchmark),
               b AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(bag) AS token FROM t) GROUP BY ALL),
               m AS (SELECT x.id AS id_a, y.id AS id_b, sum(least(x.n, y.n)) AS met FROM b x JOIN b y ON x.token = y.token AND x.id < y.id GROUP BY ALL)
          SELECT id_a, id_b, round(2 * met / (len(p.bag) + len(q.bag)), 6) AS sim FROM m JOIN t p ON p.id = id_a JOIN t q ON q.id = id_b WHERE 2 * met / (len(p.bag) + len(q.bag)) >= 0.15""")
def naive_join(spark, sf_dir):
    """Every two benchmark items: a table of a fixed size."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return simjoin.naive(items, id="item_id", cols=["text"], similarity_name="dice", threshold=0.15).select("id_a", "id_b", F.round("sim", 6).alias("sim"))


@query("SELECT a.s_suppkey AS id_a, b.s_suppkey AS id_b, levenshtein(a.s_name, b.s_name)::DOUBLE AS sim FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE levenshtein(a.s_name, b.s_name) <= 1")
def edit_join(spark, sf_dir):
    return simjoin.edit(table(spark, sf_dir, "supplier"), id="s_suppkey", cols=["s_name"], threshold=1)


@query("SELECT s_suppkey AS id_a, c_custkey AS id_b, levenshtein(s_name, c_name)::DOUBLE AS sim FROM supplier JOIN customer ON s_suppkey <> c_custkey WHERE levenshtein(s_name, c_name) <= 6")
def edit_join_two_tables(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return simjoin.edit(a, b, id="id", cols=["name"], threshold=6)


_DIRECTED = _BAGS.replace("x.id < y.id", "x.id <> y.id").format(w="1.0::DOUBLE")


@query(f"WITH {_DIRECTED} SELECT id_a, id_b, round(met / (p + q - met), 4) AS sim FROM v WHERE met / (p + q - met) + 1e-6 >= 0.7 AND {_bucket_sql('id_a', 2)} = 0")
def sample_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part, _ = consistent(docs, "doc_id", 0.5)
    return simjoin.prefix(part, docs, id="doc_id", cols=["text"], threshold=0.7).select("id_a", "id_b", F.round("sim", 4).alias("sim"))


@query("SELECT a.n_nationkey AS id_a, b.n_nationkey AS id_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def block_pairs(spark, sf_dir):
    return simjoin.block_pairs(table(spark, sf_dir, "nation"), ["n_regionkey"], id="n_nationkey")


# ---------------------------------------------------------------- cleaning


_CC = """e AS ({edges}), u AS (SELECT id_a AS a, id_b AS b FROM e UNION SELECT id_b, id_a FROM e),
         r(id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id), g AS (SELECT id, min(c) AS component FROM r GROUP BY id)"""


@query("WITH RECURSIVE " + _BAGS.format(w="1.0::DOUBLE") + ", " + _CC.format(edges="SELECT id_a, id_b FROM v WHERE met / (p + q - met) + 1e-6 >= 0.7") + " SELECT id, component FROM g")
def components(spark, sf_dir):
    return connected_components(_join_query("jaccard", False)(spark, sf_dir), "id_a", "id_b")


#: Dirty part names: brand and name, each seventh part with a word too many, each eleventh in capitals of no use.
def _dirty_parts(spark: SparkSession, sf_dir: str) -> WorkingSet:
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_brand", "p_name", "p_type", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("extra"), (F.col("p_partkey") % 3).cast("string"))))
    return WorkingSet.create(p.select("p_partkey", name.alias("label"), "p_size"), "parts", row_key=["p_partkey"], unique=True)


_PARTS = "q AS (SELECT p_partkey, concat_ws(' ', p_brand, p_name, p_type, CASE WHEN p_partkey % 7 = 0 THEN 'extra' || (p_partkey % 3) END) AS label, p_size FROM part), w AS (SELECT label AS value, md5(label) AS id, count(*) AS n FROM q GROUP BY label)"
_PART_EDGES = """SELECT x.id AS id_a, y.id AS id_b FROM pb x JOIN pb y ON x.id < y.id AND x.brand = y.brand
                 WHERE len(list_intersect(x.l, y.l)) / (len(x.l) + len(y.l) - len(list_intersect(x.l, y.l)))::DOUBLE + 1e-6 >= 0.8"""
_PB = "pb AS (SELECT id, regexp_extract_all(value, '[A-Za-z0-9_]+') AS l, string_split(value, ' ')[1] AS brand FROM w)"


def _er_sql(order: str) -> str:
    return f"""WITH RECURSIVE {_PARTS}, {_PB}, {_CC.format(edges=_PART_EDGES)},
               k AS (SELECT w.*, coalesce(component, w.id) AS component FROM w LEFT JOIN g ON g.id = w.id),
               c AS (SELECT component, first(value ORDER BY {order}, value) AS canonical FROM k GROUP BY component)
               SELECT p_partkey, canonical AS label, p_size FROM q JOIN k ON k.value = q.label JOIN c USING (component)"""


def _er_query(strategy: str):
    def run(spark, sf_dir):
        ws = _dirty_parts(spark, sf_dir)
        resolution.long("label", 0.8, weighted=False).with_(strategy=strategy)(ws)
        return ws.clean.select("p_partkey", "label", "p_size")

    return run


for _name, _strategy, _order in (("er_most_frequent", "mostFrequent", "n DESC"), ("er_most_concise", "mostConcise", "length(value)"), ("er_least_concise", "leastConcise", "length(value) DESC")):
    QUERIES[_name], SQL[_name] = _er_query(_strategy), _er_sql(_order)


@query("""WITH RECURSIVE w AS (SELECT c_mktsegment || CASE WHEN c_custkey % 9 = 0 THEN 'x' WHEN c_custkey % 10 = 0 THEN 'y' ELSE '' END AS value, c_custkey FROM customer),
               d AS (SELECT value, md5(value) AS id FROM w GROUP BY value), """ + _CC.format(edges="SELECT x.id AS id_a, y.id AS id_b FROM d x JOIN d y ON x.id < y.id AND levenshtein(x.value, y.value) <= 1") + """,
               k AS (SELECT d.*, coalesce(component, d.id) AS component FROM d LEFT JOIN g ON g.id = d.id), c AS (SELECT component, first(value ORDER BY length(value) DESC, value) AS canonical FROM k GROUP BY component)
          SELECT c_custkey, canonical AS segment FROM w JOIN k USING (value) JOIN c USING (component)""")
def er_edit(spark, sf_dir):
    bad = F.when(F.col("c_custkey") % 9 == 0, "x").when(F.col("c_custkey") % 10 == 0, "y").otherwise("")
    ws = WorkingSet.create(table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", bad).alias("segment")), row_key=["c_custkey"], unique=True)
    return resolution.short("segment", 1)(ws).clean.select("c_custkey", "segment")


@query(f"WITH {_DIRECTED}, d AS (SELECT id_a, count(*) + 1 AS dup FROM v WHERE met / (p + q - met) + 1e-6 >= 0.7 GROUP BY id_a) SELECT doc_id, coalesce(dup, 1)::INTEGER AS dup FROM documents LEFT JOIN d ON doc_id = id_a")
def record_dedup(spark, sf_dir):
    ws = WorkingSet.create(table(spark, sf_dir, "documents").select("doc_id", "text"), row_key=["doc_id"], unique=True)
    return resolution.RecordDeduplication(["text"], 0.7, False)(ws).clean.select("doc_id", "dup")


@query("SELECT page_id, s[1] AS scheme, s[2] AS host, s[3] AS first_, s[9] AS ninth FROM (SELECT page_id, string_split_regex(url, '[:/?#]+') AS s FROM pages)")
def fast_split(spark, sf_dir):
    e = extract.fast_split("url", "[:/?#]+", ["scheme", "host", "first_", *[f"c{i}" for i in range(5)], "ninth"])
    return e.apply(table(spark, sf_dir, "pages")).select("page_id", "scheme", "host", "first_", "ninth")


@query("SELECT page_id, coalesce(s[1], '') AS scheme, coalesce(s[2], '') AS host, coalesce(s[5], '') AS fifth FROM (SELECT page_id, string_split_regex(url, '[:/?#]+') AS s FROM pages)")
def split_extraction(spark, sf_dir):
    return extract.split("url", "[:/?#]+", ["scheme", "host", "a", "b", "fifth"]).apply(table(spark, sf_dir, "pages")).select("page_id", "scheme", "host", "fifth")


@query("SELECT p_partkey, coalesce(string_split_regex(p_brand, '#')[1], '') AS brand, coalesce(string_split_regex(p_brand, '#')[2], '') AS nr FROM part")
def learned_split(spark, sf_dir):
    e = extract.LearnedSplit("p_brand", ["brand", "nr"]).add("Brand#7", ["Brand", "7"])
    return e.split().apply(table(spark, sf_dir, "part")).select("p_partkey", "brand", "nr")


@query(f"""WITH p AS (SELECT a.n_nationkey AS id_a, b.n_nationkey AS id_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
                u AS (SELECT *, ('0x' || substr(md5('1/' || id_a || '/' || id_b), 1, 8))::BIGINT / 4294967296.0 AS u FROM p)
           SELECT id_a, id_b FROM u WHERE (u < 0.25 AND id_a % 2 = 0) OR u >= 0.25""")
def hybrid_routing(spark, sf_dir):
    low, high = matchers.shares([0.25, 0.75], seed=1)
    route = matchers.Hybrid().add(low, matchers.by_similarity(1 - F.col("id_a") % 2, 1)).add(high, matchers.all_pairs)
    return route(block_pairs(spark, sf_dir))


_PIPE = {
    "dataset": "parts",
    "sql_query": "select label, count(*) as n from $t group by label",
    "pipeline": [
        {"name": "longAttributeER", "attribute": "label", "threshold": 0.8, "weighting": "false"},
        {"name": "splitExtraction", "attribute": "label", "delimiter": " ", "output_columns": "brand,rest"},
    ],
}


@query(_er_sql("n DESC").replace("SELECT p_partkey, canonical AS label, p_size FROM", "SELECT canonical AS label, count(*) AS n FROM") + " GROUP BY canonical")
def json_pipeline(spark, sf_dir):
    return run_pipeline(json.dumps(_PIPE), {"parts": _dirty_parts(spark, sf_dir)})["0"][-1]


# ---------------------------------------------------------------- features, learning, evaluation


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), p AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)
          SELECT w AS word, count(*) AS n FROM p JOIN v USING (w) WHERE w <> '' GROUP BY w""")
def one_hot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    parts = table(spark, sf_dir, "part")
    vocab = features.vocabulary(parts, "p_name")
    hot = features.one_hot(parts, "p_name", "v", vocab).select(F.posexplode(vector_to_array("v")).alias("i", "x")).groupBy("i").agg(F.sum("x").cast("long").alias("n"))
    return hot.select(F.element_at(F.array(*[F.lit(w) for w in vocab]), F.col("i") + 1).alias("word"), "n")


@query("""SELECT o_orderkey, coalesce(try_cast(left(o_orderpriority, 1) AS DOUBLE), -1) AS a, coalesce(try_cast(o_orderpriority AS DOUBLE), -1) AS b FROM orders""")
def numeric_feature(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", number(F.substring("o_orderpriority", 1, 1), -1.0).alias("a"), number("o_orderpriority", -1.0).alias("b"))


@query("SELECT r_regionkey, r_regionkey::DOUBLE AS key_, len(string_split(r_name, ' '))::DOUBLE AS hot FROM region")
def feature_view(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array(F.col("features"))
    return features.feature_view(table(spark, sf_dir, "region"), [("r_regionkey", "number"), ("r_name", "categorical")]).select("r_regionkey", v[0].alias("key_"), F.aggregate(F.slice(v, 2, 1000), F.lit(0.0), lambda s, x: s + x).alias("hot"))


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents as points, by length, share of letters and mean word length."""
    from pyspark.ml.functions import array_to_vector

    text = F.coalesce("text", F.lit(""))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.greatest(F.length(text), F.lit(1))
    words = F.size(F.split(text, r"\s+"))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    id_ = F.col("doc_id").cast("string").alias("id")
    points = docs.select(id_, array_to_vector(F.array(F.log1p(F.length(text)), letters * 10, F.length(text) / words)).alias("features"))
    return points, docs.select(id_, F.col("quality").cast("double").alias("label"))


@query()
def active_learning(spark, sf_dir):
    """Errors of actively trained models, batch by batch. Labels come from the table of labels; tests check the loop."""
    points, truth = _points(spark, sf_dir)
    learner = active.ActiveLearner(active.svm(20, 0.01), active.margin_selector, active.TableLabels(truth), budget=40, batch=10, bootstrap=10)
    full = points.join(truth, "id")
    rows = [(s.labelled.count(), active.train_error(s.model, full)) for s in learner.steps(points)]
    return spark.createDataFrame(rows, "labels long, error double")


@query("""SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn,
                 round(count(*) FILTER (quality <> toxic) / count(*), 6) AS error, round(coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 0), 6) AS precision,
                 round(coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1), 0), 0), 6) AS recall,
                 round(coalesce(2 * count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 1), 0), 0), 6) AS f1 FROM labels""")
def confusion(spark, sf_dir):
    got = active.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")
    return got.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("error", "precision", "recall", "f1")])


def _mapped(spark, sf_dir) -> WorkingSet:
    ws = _customers(spark, sf_dir)
    return ws.replace(ws.clean.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))))


@query("SELECT count(*) FILTER (c_custkey % 4 <> 0) AS hits, count(*) AS total, round(count(*) FILTER (c_custkey % 4 <> 0) / count(*), 6) AS accuracy FROM customer WHERE c_custkey % 3 = 0")
def unary_accuracy(spark, sf_dir):
    ws = _mapped(spark, sf_dir)
    truth = ws.dirty.where("c_custkey % 3 = 0").select("hash", F.lit("c_mktsegment").alias("attr"), F.col("c_mktsegment").alias("value"))
    return evaluate.unary_accuracy(ws.clean, truth).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH p AS (SELECT a.c_custkey % 4 = 0 AS la, b.c_custkey % 4 = 0 AS lb, a.c_mktsegment AS x, b.c_mktsegment AS y FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)
          SELECT count(*) FILTER ((la = lb AND x = y) = (x = y)) AS hits, count(*) AS total, round(count(*) FILTER ((la = lb AND x = y) = (x = y)) / count(*), 6) AS accuracy FROM p""")
def binary_accuracy(spark, sf_dir):
    ws = _mapped(spark, sf_dir)
    a = ws.dirty.select(F.col("hash").alias("hash1"), (F.col("c_custkey") + 1).alias("k"), F.col("c_mktsegment").alias("x"))
    b = ws.dirty.select(F.col("hash").alias("hash2"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("y"))
    truth = a.join(b, "k").select("hash1", "hash2", F.lit("c_mktsegment").alias("attr"), (F.col("x") == F.col("y")).alias("same"))
    return evaluate.binary_accuracy(ws.clean, truth).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {_PARTS}, l AS (SELECT *, regexp_extract_all(value, '[A-Za-z0-9_]+') AS l FROM w)
           SELECT sum(x.n * y.n)::BIGINT AS pairs FROM l x, l y WHERE len(list_intersect(x.l, y.l)) / (len(x.l) + len(y.l) - len(list_intersect(x.l, y.l)))::DOUBLE > 0.8""")
def candidate_count(spark, sf_dir):
    ws = _dirty_parts(spark, sf_dir)
    n = evaluate.candidate_count(ws.clean, "label", 0.8)
    return spark.createDataFrame([(n,)], "pairs long")


# ---------------------------------------------------------------- plain SQL


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def sql_window(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def sql_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def sql_set(spark, sf_dir):
    session = Session(spark)
    for name in ("customer", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"tidemark_{name}")
    return session.sql("select c_custkey from tidemark_customer except select o_custkey from tidemark_orders where o_orderstatus = 'F'")


@query("SELECT count(*) AS n, count(DISTINCT c_name) AS names, round(avg(c_acctbal), 4) AS mean, round(sum(c_acctbal), 2) AS total, round(var_samp(c_acctbal), 2) AS spread FROM customer WHERE c_custkey % 3 = 1")
def sql_aggregates(spark, sf_dir):
    return _customers(spark, sf_dir).query("select count(*) as n, count(distinct c_name) as names, round(avg(c_acctbal), 4) as mean, round(sum(c_acctbal), 2) as total, round(var_samp(c_acctbal), 2) as spread from $t where c_custkey % 3 = 1")


# ---------------------------------------------------------------- sources, sinks and the catalog


@query("SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS label, c_acctbal FROM customer")
def csv_scan(spark, sf_dir):
    """Quoted CSV, written and read back under a schema."""
    path = new_path(spark, "csv")
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), "c_acctbal").write.options(quote='"', escape='"').csv(path)
    return read_csv(spark, path, [("c_custkey", "bigint"), ("label", "string"), ("c_acctbal", "double")])


@query("SELECT s_suppkey::VARCHAR AS key_, s_name AS name, '' AS rest FROM supplier")
def text_scan(spark, sf_dir):
    path = new_path(spark, "text")
    table(spark, sf_dir, "supplier").select(F.concat_ws("|", "s_suppkey", "s_name")).write.text(path)
    return read_text(spark, path, r"\|", ["key_", "name", "rest"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def table_scan(spark, sf_dir):
    catalog.create_shared(table(spark, sf_dir, "orders"), "tidemark_table_scan")
    return read_table(spark, "tidemark_table_scan", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'O'")


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def json_files(spark, sf_dir):
    path = new_path(spark, "json")
    write_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.text(path)


@query("SELECT c_custkey AS k, coalesce(try_cast(c_name AS INTEGER), -1) AS n, try_cast(substr(c_name, 10) AS BIGINT) AS m FROM customer")
def typed_coercion(spark, sf_dir):
    schema = spark.createDataFrame([], "k long, n int, m long").schema
    return coerce(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"), "c_name", F.substring("c_name", 10, 100)), schema).fillna(-1, ["n"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer")
def write_back_table(spark, sf_dir):
    """The cleaned rows take the place of the table's own in the catalog."""
    catalog.create_shared(table(spark, sf_dir, "customer"), "tidemark_write_back")
    ws = WorkingSet.create(spark.table("tidemark_write_back"), "tidemark_write_back", row_key=["c_custkey"], unique=True)
    ws.replace(ws.clean.withColumn("c_mktsegment", F.lower("c_mktsegment"))).write_back(table="tidemark_write_back")
    return spark.table("tidemark_write_back")


@query("SELECT s_suppkey, s_name, 1::BIGINT AS checked, 'yes' AS property FROM supplier UNION ALL SELECT s_suppkey, s_name, 0, 'yes' FROM supplier")
def table_ddl(spark, sf_dir):
    """A table is made, given a property and a column, renamed, and added to."""
    for name in ("tidemark_ddl", "tidemark_ddl_new"):
        catalog.drop(spark, name)
    catalog.create_shared(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "tidemark_ddl", {"tidemark.own": "yes"})
    catalog.add_columns(spark, "tidemark_ddl", {"checked": "bigint"})
    catalog.rename(spark, "tidemark_ddl", "tidemark_ddl_new")
    own = catalog.properties(spark, "tidemark_ddl_new")["tidemark.own"]
    return catalog.append(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(1).cast("long").alias("checked")), "tidemark_ddl_new").fillna(0, ["checked"]).withColumn("property", F.lit(own))


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def saved_set(spark, sf_dir):
    """A working set is saved to the catalog and opened by another session."""
    session = Session(spark)
    session.sets["tidemark_saved"] = ws = _customers(spark, sf_dir)
    ws.replace(ws.clean.withColumn("c_name", F.upper("c_name")))
    session.save("tidemark_saved")
    return Session(spark).open("tidemark_saved").clean.select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('7/' || md5('v' || o_orderkey)), 1, 8))::BIGINT / 4294967296.0 < 0.3")
def uniform_sample(spark, sf_dir):
    return WorkingSet.create(table(spark, sf_dir, "orders"), ratio=0.3, seed=7, row_key=["o_orderkey"], unique=True).clean.select("o_orderkey")


# ---------------------------------------------------------------- joins of samples that share names


_SHARED = f"""{_S}, o AS (SELECT o_orderkey, o_totalprice AS l_extendedprice, o_orderstatus AS l_returnflag FROM orders),
              j AS (SELECT s.l_orderkey, o.l_extendedprice AS price, o.l_returnflag AS flag, s.l_returnflag AS own FROM s JOIN o ON l_orderkey = o_orderkey), q AS (SELECT *, count(*) OVER ()::DOUBLE AS k FROM j)"""


def _shared_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("l_extendedprice"), F.col("o_orderstatus").alias("l_returnflag"))


@query(f"{_SHARED} {_raw_sql('q', 'CASE WHEN own <> chr(79) THEN price ELSE 0 END', 'flag')}")
def raw_join_shared_name(spark, sf_dir):
    """Both tables have the price and the flag; a literal that looks like a qualified name stays one."""
    session = _lines(spark, sf_dir)
    session.sample(_shared_orders(spark, sf_dir), "o", row_key=["o_orderkey"], unique=True)
    return _rounded(session.sql("selectrawsc sum(o.l_extendedprice) from lines join o on lines.l_orderkey = o.o_orderkey where lines.l_returnflag <> 'O' and 'o.x' <> 'x' group by o.l_returnflag"))


@query(f"""{_D}, j AS (SELECT s.d, s.c, s.k, o.o_orderstatus AS flag FROM s LEFT JOIN orders o ON l_orderkey = o_orderkey) {_raw_sql('j', 'd - c', 'flag')}""")
def nsc_join_shared_name(spark, sf_dir):
    session, ws = Session(spark), _dirty_lines(spark, sf_dir)
    session.sets["lines"] = ws
    session.sample(_shared_orders(spark, sf_dir).withColumn("price", F.lit(0.0)), "o", row_key=["o_orderkey"], unique=True)
    return _rounded(session.sql("selectnsc sum(lines.price) from lines join o on lines.l_orderkey = o.o_orderkey group by o.l_returnflag"))


# ---------------------------------------------------------------- presets, matchers, tuning


_LABEL_BAGS = _BAGS.replace("SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') AS l FROM documents", "SELECT id, regexp_extract_all(value, '[A-Za-z0-9_]+') AS l FROM w").format(w="log10((SELECT count(*) FROM w) / count(*))")


@query(_er_sql("n DESC").replace(f"{_PB}, ", f"{_LABEL_BAGS}, ").replace(_PART_EDGES, "SELECT id_a, id_b FROM v WHERE met / nullif(p + q - met, 0) + 1e-6 >= 0.8"))
def er_long_weighted(spark, sf_dir):
    ws = _dirty_parts(spark, sf_dir)
    resolution.long("label", 0.8)(ws)
    return ws.clean.select("p_partkey", "label", "p_size")


_DIRECTED_WEIGHTED = _BAGS.replace("x.id < y.id", "x.id <> y.id").format(w="log10((SELECT count(*) FROM documents) / count(*))")


@query(f"WITH {_DIRECTED_WEIGHTED}, d AS (SELECT id_a, count(*) + 1 AS dup FROM v WHERE met / nullif(p + q - met, 0) + 1e-6 >= 0.9 GROUP BY id_a) SELECT doc_id, coalesce(dup, 1)::INTEGER AS dup FROM documents LEFT JOIN d ON doc_id = id_a")
def record_dedup_weighted(spark, sf_dir):
    """The preset as it comes: weighted, 0.9."""
    ws = WorkingSet.create(table(spark, sf_dir, "documents").select("doc_id", "text"), row_key=["doc_id"], unique=True)
    return resolution.RecordDeduplication(["text"])(ws).clean.select("doc_id", "dup")


_STAGES = {"dataset": "parts", "sql_query": _PIPE["sql_query"], "stages": [{"operator": "attrdedup", "field": "label", "options": {"similarity": "dice", "threshold": 0.9}}, {"operator": "extract", "field": "label", "options": {"delimiter": " ", "output_columns": "brand,rest"}}]}


@query()
def stages_pipeline(spark, sf_dir):
    return run_pipeline(json.dumps(_STAGES), {"parts": _dirty_parts(spark, sf_dir)})["0"][-1]


SQL["stages_pipeline"] = f"""WITH RECURSIVE {_PARTS}, {_LABEL_BAGS}, {_CC.format(edges="SELECT id_a, id_b FROM v WHERE 2 * met / nullif(p + q, 0) >= 0.9")},
    k AS (SELECT w.*, coalesce(component, w.id) AS component FROM w LEFT JOIN g ON g.id = w.id), c AS (SELECT component, first(value ORDER BY n DESC, value) AS canonical FROM k GROUP BY component)
    SELECT canonical AS label, count(*) AS n FROM q JOIN k ON k.value = q.label JOIN c USING (component) GROUP BY canonical"""


@query("""WITH p AS (SELECT a.n_nationkey AS id_a, b.n_nationkey AS id_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)
          SELECT id_a, id_b FROM p JOIN labels ON doc_id = id_a * 25 + id_b WHERE quality > 0.5""")
def crowd_matcher(spark, sf_dir):
    """Pairs that the table of labels says match; a pair's label is that of a document."""
    answers = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 25).alias("id_a"), (F.col("doc_id") % 25).alias("id_b"), F.col("quality").cast("double").alias("label"))
    return matchers.by_labels(answers)(block_pairs(spark, sf_dir))


@query("SELECT a.s_suppkey AS id_a, b.s_suppkey AS id_b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE levenshtein(a.s_name, b.s_name) <= 1 AND (a.s_suppkey + b.s_suppkey) % 2 = 0")
def match_sequence(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    sequence = matchers.MatchSequence(lambda a: simjoin.edit(a, id="s_suppkey", cols=["s_name"], threshold=1)).add(matchers.by_similarity(1 - (F.col("id_a") + F.col("id_b")) % 2, 1))
    return sequence.run(suppliers).select("id_a", "id_b")


@query("SELECT s_suppkey AS id_a, c_custkey AS id_b FROM supplier JOIN customer ON s_suppkey <> c_custkey WHERE levenshtein(s_name, c_name) <= 6 AND (s_suppkey + c_custkey) % 2 = 0")
def match_sequence_two_tables(spark, sf_dir):
    """Two tables whose columns have different names, brought under one schema."""
    a = simjoin.by_schema(table(spark, sf_dir, "supplier"), {"s_suppkey": "id", "s_name": "name"})
    b = simjoin.by_schema(table(spark, sf_dir, "customer"), {"c_custkey": "id", "c_name": "name"})
    sequence = matchers.MatchSequence(lambda x, y: simjoin.edit(x, y, id="id", cols=["name"], threshold=6)).add(matchers.by_similarity(1 - (F.col("id_a") + F.col("id_b")) % 2, 1))
    return sequence.run(a, b).select("id_a", "id_b")


@query("SELECT 'none' AS algorithm, round(count(*) FILTER (c_custkey % 4 <> 0) / count(*), 6) AS accuracy FROM customer UNION ALL SELECT 'upper', 1.0::DOUBLE")
def evaluator(spark, sf_dir):
    ws = _mapped(spark, sf_dir)
    truth = ws.dirty.select("hash", F.lit("c_mktsegment").alias("attr"), F.upper("c_mktsegment").alias("value"))
    ws.rebase()
    got = evaluate.Evaluator(ws, unary=truth).evaluate({"none": lambda w: w, "upper": lambda w: w.replace(w.clean.withColumn("c_mktsegment", F.upper("c_mktsegment")))})
    return spark.createDataFrame([(k, round(v["unary"], 6)) for k, v in got.items()], "algorithm string, accuracy double")


_TIED = f"""WITH {_PARTS}, l AS (SELECT p_partkey, list_distinct(regexp_extract_all(label, '[A-Za-z0-9_]+')) AS s, regexp_extract_all(label, '[A-Za-z0-9_]+') AS l FROM q),
            b AS (SELECT p_partkey, token, count(*) AS n FROM (SELECT p_partkey, unnest(l) AS token FROM l) GROUP BY ALL),
            m AS (SELECT x.p_partkey, sum(least(x.n, y.n)) AS met FROM b x JOIN b y ON x.token = y.token AND y.p_partkey = x.p_partkey + 1 WHERE x.p_partkey % 2 = 0 GROUP BY ALL),
            e AS (SELECT met / (len(x.l) + len(y.l) - met) AS sim FROM m JOIN l x USING (p_partkey) JOIN l y ON y.p_partkey = x.p_partkey + 1)"""


def _tied_parts(spark, sf_dir) -> tuple[WorkingSet, DataFrame]:
    """Every even part is said to be the same as the next one."""
    ws = _dirty_parts(spark, sf_dir)
    a = ws.clean.where("p_partkey % 2 = 0").select(F.col("hash").alias("hash1"), (F.col("p_partkey") + 1).alias("k"))
    b = ws.clean.select(F.col("hash").alias("hash2"), F.col("p_partkey").alias("k"))
    return ws, a.join(b, "k").select("hash1", "hash2", F.lit("label").alias("attr"), F.lit(True).alias("same"))


@query(f"{_TIED} SELECT round(min(sim), 6) AS threshold FROM e WHERE sim > 1e-6")
def tune_threshold(spark, sf_dir):
    ws, binary = _tied_parts(spark, sf_dir)
    return spark.createDataFrame([(round(resolution.long("label").tune(ws, binary).threshold, 6),)], "threshold double")


@query(f"{_TIED} SELECT round(max(sim), 6) AS threshold FROM e WHERE sim < 1")
def persistence(spark, sf_dir):
    ws, binary = _tied_parts(spark, sf_dir)
    return spark.createDataFrame([(round(resolution.long("label").tune_persistent(ws, binary).threshold, 6),)], "threshold double")


_MORE_METRICS = ["BlockDistance", "ChapmanLengthDeviation", "ChapmanMeanLength", "EuclideanDistance", "MatchingCoefficient", "OverlapCoefficient"]


@query("""WITH p AS (SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key, replace(a.n_name, '_', ' ') AS a, replace(b.n_name, '_', ' ') AS b FROM nation a, nation b),
               t AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y, length(a) + length(b) AS n FROM p), m AS (SELECT *, len(list_intersect(x, y)) AS met FROM t)
          SELECT a_key, b_key, round(2 * met / (len(x) + len(y)), 6) AS "BlockDistance", round(least(length(a), length(b)) / greatest(length(a), length(b)), 6) AS "ChapmanLengthDeviation",
                 round(CASE WHEN n > 500 THEN 1 ELSE 1 - pow((500 - n) / 500, 4) END, 6) AS "ChapmanMeanLength",
                 round(1 - sqrt(len(x) + len(y) - 2 * met) / sqrt(len(x) * len(x) + len(y) * len(y)), 6) AS "EuclideanDistance",
                 round(met / greatest(len(x), len(y)), 6) AS "MatchingCoefficient", round(met / least(len(x), len(y)), 6) AS "OverlapCoefficient" FROM m""")
def string_metrics_more(spark, sf_dir):
    """Metrics of every two nations' names: 25 rows, whatever the scale."""
    ship(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"))
    pairs = F.broadcast(n.select(F.col("n_nationkey").alias("a_key"), F.col("name").alias("a"))).crossJoin(n.select(F.col("n_nationkey").alias("b_key"), F.col("name").alias("b")))
    return pairs.select("a_key", "b_key", *[F.round(metrics.string_metric(m, F.col("a"), F.col("b")), 6).alias(m) for m in _MORE_METRICS])
