"""Queries of the table engine: corpus, search, scoring, dependencies, matching, look-ups and evaluation.

The query table is the first ordinary corpus table of ten and more rows whose first pair of cells also begins another
table: keys in column 0, values in column 1. Its first rows are the examples; the values of the others are to be found,
and take no part in any search. The query table itself is taken out of the corpus. Every SQL twin is written on its own,
from the semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions import text
from tabweave.operators import em, evaluate, fd, forms, graph, indirect, lookup, match, score, search, strings
from tabweave.plans.common import parallelism, scratch, table, written
from tabweave.sources import corpus
from tabweave.sources import lookup_source as lookup_source_module

QUERIES: dict = {}
SQL: dict[str, str] = {}
LEAST, GIVEN, ASKED, SEARCHES = 2, 3, 50, 2
#: Smaller ids are the corpus' largest tables; a query table is an ordinary one.
FIRST = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _WITH + sql
        return f

    return add


# relations that several queries start from, in both languages

_RATED = """
 tabs{i} as (select mid, coalesce(max(confidence), 0.5) prior, any_value(s) "schema" from (select distinct mid, tableid, x_col, y_col from ev{i}) a join hdr using (tableid, x_col, y_col) left join new_tables_tokenized_full t on t.id = a.tableid group by mid),
 ekey{i} as (select k, max(score) top from ex{p} group by k),
 evid{i} as (select mid, good, total, (select coalesce(sum(top), 0) from ekey{i}) - seen unseen from (select a.mid, sum(coalesce(e.score, 0.0)) good, count(*)::double total from ev{i} a join ekey{i} using (k) left join ex{p} e on e.k = a.k and e.v = a.v group by a.mid) join (select mid, sum(top) seen from (select distinct a.mid, a.k, top from ev{i} a join ekey{i} using (k)) group by mid) using (mid)),
 rat{i} as (select mid, ((coalesce((good + prior * unseen) * 0.99 / nullif(total + unseen, 0), 0)) + "schema") / 2 rating from evid{i} join tabs{i} using (mid)),
 ar{i} as (select k, v, mid, rating from ev{i} join rat{i} using (mid)),
 kt{i} as (select k, mid, any_value(rating) r from ar{i} group by k, mid),
 kv{i} as (select distinct k, v from ar{i}),
 sf{i} as (select kv.k, kv.v, product(case when ar.mid is not null then r else 1 - r end) s from kv{i} kv join kt{i} kt on kt.k = kv.k left join ar{i} ar on ar.k = kv.k and ar.v = kv.v and ar.mid = kt.mid group by kv.k, kv.v),
 scored{i} as (select sf.k, sf.v, coalesce(s / nullif(z + none, 0), 0) score from sf{i} sf join (select k, sum(s) z from sf{i} group by k) using (k) join (select k, product(1 - r) none from kt{i} group by k) using (k)),
 ex{i} as (select k, v, score from ex0 union all select k, v, score from (select *, row_number() over (partition by k order by round(score, 9) desc, v) i from scored{i}) where i = 1 and k not in (select k from ex0))"""

_SEARCHED = """
 ask{i} as (select k, v from ex{p} order by score desc, k, v limit 50),
 xcol{i} as (select tableid, colid from uc where tokenized in (select k from ask{i}) group by all having count(distinct tokenized) >= 2),
 ycol{i} as (select tableid, colid from uc where tokenized in (select v from ask{i}) group by all having count(distinct tokenized) >= 2),
 matches{i} as (select x.tableid, x.colid x_col, y.colid y_col from xcol{i} x join ycol{i} y on x.tableid = y.tableid and x.colid <> y.colid where (x.tableid, x.colid, y.colid) not in (select (tableid, x_col, y_col) from seen{p})),
 seen{i} as (select * from seen{p} union all select * from matches{i}),
 mapped{i} as (select m.tableid, m.x_col, m.y_col, a.tokenized k, b.tokenized v, count(*) n from matches{i} m join uc a on a.tableid = m.tableid and a.colid = m.x_col join uc b on b.tableid = m.tableid and b.colid = m.y_col and b.rowid = a.rowid group by all),
 cand{i} as (select distinct concat(tableid, ':', x_col, ':', y_col) mid, tableid, x_col, y_col, k, v from mapped{i}),
 checked{i} as (select mid, a.k, sum(coalesce(e.score, 0.0)) good, sum(case when e.score is null then 1.0 else 0.0 end) bad, count(e.score) n_good from cand{i} a left join ex0 e on e.k = a.k and e.v = a.v where a.k in (select k from ex0) group by mid, a.k),
 ok{i} as (select mid from checked{i} group by mid having sum(n_good) >= 2 and sum(good) >= 0.3 * (sum(good) + sum(bad))),
 ev{i} as (select * from ev{p} union select mid, tableid, x_col, y_col, k, v from cand{i} where mid in (select mid from ok{i}) and k in (select k from rows0)),"""

_WITH = """with cells as (select distinct tableid, colid, rowid, term, tokenized from main_tokenized),
 u as (select tableid, colid, rowid, tokenized from cells where tokenized <> ''),
 heads as (select a.tableid, a.tokenized k, b.tokenized v from u a join u b on a.tableid = b.tableid and a.rowid = b.rowid where a.rowid = 0 and a.colid = 0 and b.colid = 1 and a.tableid >= 1000),
 t0 as (select min(tableid) id from heads h where tableid in (select tableid from u where rowid >= 9) and exists (select 1 from heads o where o.k = h.k and o.v = h.v and o.tableid <> h.tableid)),
 rows0 as (select a.rowid, a.tokenized k, b.tokenized v from u a join u b on a.tableid = b.tableid and a.rowid = b.rowid where a.tableid = (select id from t0) and a.colid = 0 and b.colid = 1),
 ex0 as (select k, min(v) v, 1.0::double score from (select * from rows0 order by rowid limit 3) group by k),
 uc as (select * from u where tableid <> (select id from t0)),
 head as (select tableid, colid, min(header_tokenized) h from columns_tokenized group by 1, 2),
 sims as (select a.h a, b.h b, 1 - levenshtein(a.h, b.h)::double / greatest(length(a.h), length(b.h), 1) s from (select distinct h from head) a, (select distinct h from head where tableid = (select id from t0) and colid in (0, 1)) b),
 sim as (select a, b, case when s < 0.5 then 0.0 else s end s from sims where s is not null union all select h, null, 0.0 from (select distinct h from head where h is not null) union all select null, h, 0.0 from (select distinct h from head where h is not null) union all select null, null, 1.0),
 hdr as (select x.tableid, x.colid x_col, y.colid y_col, case when hx.h is null and hy.h is null then 0.5 else (sx.s + sy.s) / 2 end s from (select distinct tableid, colid from u) x join (select distinct tableid, colid from u) y on x.tableid = y.tableid and x.colid <> y.colid
  left join head hx on hx.tableid = x.tableid and hx.colid = x.colid left join head hy on hy.tableid = y.tableid and hy.colid = y.colid left join head ox on ox.tableid = (select id from t0) and ox.colid = 0 left join head oy on oy.tableid = (select id from t0) and oy.colid = 1
  left join sim sx on sx.a is not distinct from hx.h and sx.b is not distinct from ox.h left join sim sy on sy.a is not distinct from hy.h and sy.b is not distinct from oy.h),
 seen0 as (select 1::bigint tableid, 0 x_col, 0 y_col where false), ev0 as (select '' mid, 0::bigint tableid, 0 x_col, 0 y_col, '' k, '' v where false),""" + "".join(_SEARCHED.format(i=i, p=i - 1) + _RATED.format(i=i, p=i - 1) + "," for i in range(1, SEARCHES + 1)) + """
 ex as (select * from ex0), matches as (select * from matches1), mapped as (select * from mapped1), cand as (select * from cand1), checked as (select * from checked1), ans as (select * from ev1),
 bad as (select distinct a.k, a.v from cand a where a.k in (select k from ex) and not exists (select 1 from ex e where e.k = a.k and e.v = a.v)),
 tabs as (select * from tabs1), evid as (select * from evid1), rat as (select * from rat1), ar as (select * from ar1), scored as (select * from scored1),
 xcol as (select tableid, colid from uc where tokenized in (select k from rows0) group by all having count(distinct tokenized) >= 2)
"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "main_tokenized").distinct()


_T0: dict[tuple[str, str], int] = {}


def _t0(spark: SparkSession, d: str) -> int:
    """The query table's id, found once for each folder."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _T0:
        c = table(spark, d, "main_tokenized").where(f"tableid >= {FIRST} and tokenized <> ''")
        cell = lambda i: F.min(F.when((F.col("rowid") == 0) & (F.col("colid") == i), F.col("tokenized")))
        first = c.groupBy("tableid").agg(cell(0).alias("k"), cell(1).alias("v"), F.max("rowid").alias("last")).where("k is not null and v is not null")
        twins = first.groupBy("k", "v").agg(F.count("*").alias("n"), F.min(F.when(F.col("last") >= 9, F.col("tableid"))).alias("id")).where("n > 1")
        _T0[at] = twins.agg(F.min("id")).first()[0]
    return _T0[at]


def rest(spark: SparkSession, d: str) -> DataFrame:
    """The corpus that is searched: all cells but the query table's."""
    return table(spark, d, "main_tokenized").where(F.col("tableid") != F.lit(_t0(spark, d)))


def rows0(spark: SparkSession, d: str) -> DataFrame:
    """(rowid, k, v) of the query table."""
    c = table(spark, d, "main_tokenized").where((F.col("tableid") == F.lit(_t0(spark, d))) & (F.col("tokenized") != "")).distinct()
    k = c.where("colid = 0").select("rowid", F.col("tokenized").alias("k"))
    return k.join(c.where("colid = 1").select("rowid", F.col("tokenized").alias("v")), "rowid")


def examples(spark: SparkSession, d: str) -> DataFrame:
    given = rows0(spark, d).orderBy("rowid").limit(GIVEN).groupBy("k").agg(F.min("v").alias("v")).withColumn("score", F.lit(1.0))
    return spark.createDataFrame(given.collect(), given.schema)  # GIVEN rows at most


def _tok(df: DataFrame, c: str) -> DataFrame:
    return df.select(F.col(c).alias("tokenized")).distinct()


def matches(spark: SparkSession, d: str) -> DataFrame:
    e = examples(spark, d).collect()  # GIVEN rows at most
    return search.find_tables(rest(spark, d), [r["k"] for r in e], [r["v"] for r in e], LEAST)


def mapped(spark: SparkSession, d: str) -> DataFrame:
    return score.table_map(rest(spark, d), written(matches(spark, d), "matches"))


def cand(spark: SparkSession, d: str) -> DataFrame:
    """What the candidate tables say, before any is accepted."""
    return written(score.answers(mapped(spark, d)), "candidates")


def ans(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """The answers of accepted tables for the input's keys; written once, as the scoring queries read it several times."""
    found = cand(spark, d) if found is None else found
    return written(score.accepted(found, examples(spark, d), rows0(spark, d).select("k"), LEAST), "answers")


#: All that tables with two of the keys say of them, in any other column: most of it contradicts the examples.
_WIDE = "wide as (select distinct concat(x.tableid, ':', x.colid, ':', b.colid) mid, a.tokenized k, b.tokenized v from xcol x join uc a on a.tableid = x.tableid and a.colid = x.colid join uc b on b.tableid = a.tableid and b.rowid = a.rowid and b.colid <> a.colid where a.tokenized in (select k from rows0)), wbad as (select distinct k, v from wide where k in (select k from ex) and (k, v) not in (select (k, v) from ex))"


def wide(spark: SparkSession, d: str) -> DataFrame:
    c, r = rest(spark, d), rows0(spark, d)
    x = written(find_x_tables(spark, d), "x-columns")
    others = c.where("tokenized <> ''").join(search.small(x.select("tableid").distinct()), "tableid", "left_semi").select("tableid", F.col("colid").alias("y_col")).distinct()
    m = written(x.join(others, "tableid").where("x_col <> y_col"), "wide-columns")
    return written(score.answers(score.table_map(c, m)).join(search.small(r.select("k").distinct()), "k", "left_semi"), "wide")


def tabs(spark: SparkSession, d: str, answers_: DataFrame | None = None) -> DataFrame:
    """(mid, prior, schema): confidence of the table, likeness of its headers."""
    prior = table(spark, d, "new_tables_tokenized_full").groupBy(F.col("id").alias("tableid")).agg(F.max("confidence").alias("p"))
    mids = score.named((ans(spark, d) if answers_ is None else answers_).select("mid").distinct())
    alike = _schema(spark, d, mids.drop("mid")).select("mid", "schema")
    return mids.join(prior, "tableid", "left").join(alike, "mid").select("mid", F.coalesce("p", F.lit(0.5)).alias("prior"), "schema")


_OWN: dict[tuple[str, str], dict[int, str]] = {}


def _own_headers(spark: SparkSession, d: str) -> dict[int, str]:
    """The headers of the query table's two columns, read once."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _OWN:
        h = table(spark, d, "columns_tokenized").where((F.col("tableid") == F.lit(_t0(spark, d))) & F.col("colid").isin(0, 1))
        _OWN[at] = {r["colid"]: r["h"] for r in h.groupBy("colid").agg(F.min("header_tokenized").alias("h")).collect()}
    return _OWN[at]


def _schema(spark: SparkSession, d: str, m: DataFrame) -> DataFrame:
    """m (tableid, x_col, y_col). (mid, schema)."""
    h = table(spark, d, "columns_tokenized").join(m.select("tableid").distinct(), "tableid", "left_semi")
    h = h.groupBy("tableid", "colid").agg(F.min("header_tokenized").alias("h"))
    own = _own_headers(spark, d)
    x, y = h.withColumnsRenamed({"colid": "x_col", "h": "x_header"}), h.withColumnsRenamed({"colid": "y_col", "h": "y_header"})
    p = m.join(x, ["tableid", "x_col"], "left").join(y, ["tableid", "y_col"], "left")
    p = p.select(F.concat_ws(":", "tableid", "x_col", "y_col").alias("mid"), "x_header", "y_header", F.lit(own.get(0)).cast("string").alias("x_wanted"), F.lit(own.get(1)).cast("string").alias("y_wanted"))
    return score.schema_match(p)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# sources, projection, row and column edits


@query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey < 20")
def scan_csv(spark, d):
    path = scratch(spark, "csv-nation")
    table(spark, d, "nation").where("n_nationkey < 20").selectExpr("cast(n_nationkey as string) n_nationkey", "n_name", "cast(n_regionkey as string) n_regionkey").write.csv(path, header=True)
    r = corpus.read_csv(spark, path, ["n_nationkey", "n_name", "n_regionkey"])
    return r.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("select colid, count(*) n_cells, count(distinct term) n_terms from (select 0 colid, cast(n_nationkey as varchar) term from nation union all select 1, n_name from nation union all select 2, cast(n_regionkey as varchar) from nation) group by colid")
def scan_multi(spark, d):
    path = scratch(spark, "csv-multi")
    table(spark, d, "nation").selectExpr("cast(n_nationkey as string) a", "n_name b", "cast(n_regionkey as string) c").write.csv(path)
    return corpus.read_lookup_files(spark, [path], 3).groupBy("colid").agg(F.count("*").alias("n_cells"), F.count_distinct("term").alias("n_terms"))


@query("select table_name \"table\", column_name \"column\", (ordinal_position - 1)::int \"position\" from information_schema.columns where table_name in ('nation', 'region')")
def catalog_columns(spark, d):
    """The catalog after a script has made its tables."""
    path = scratch(spark, "script")
    lines = [("-- a comment",)] + [(f"create or replace temporary view {t} as select * from parquet.`{d}/{t}.parquet`;",) for t in ("nation", "region")]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    corpus.run_script(spark, path)
    found = corpus.catalog_columns(spark).where("table in ('nation', 'region')")
    for t in ("nation", "region"):
        spark.catalog.dropTempView(t)
    return found


@query("select colid, rowid, term from cells where tableid = (select id from t0)")
def load_table(spark, d):
    return corpus.load_table(table(spark, d, "main_tokenized"), _t0(spark, d))


@query("select tableid, count(*) n_cells from cells where tableid in (select tableid from matches) group by tableid")
def load_tables_batch(spark, d):
    return corpus.load_tables(cells(spark, d), matches(spark, d)).groupBy("tableid").agg(F.count("*").alias("n_cells"))


@query("select n_nationkey tid, n_name from nation")
def load_file(spark, d):
    path = scratch(spark, "files")
    corpus.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey"), f"{path}/nation")
    t = corpus.load_file(spark, path, "nation")
    return t.select(F.col("tid").cast("int").alias("tid"), "n_name")


@query("select n_name, n_regionkey::varchar k from nation")
def txt_to_csv(spark, d):
    path = scratch(spark, "txt")
    table(spark, d, "nation").select(F.concat("n_name", F.lit("  \t "), F.col("n_regionkey").cast("string"))).write.text(f"{path}/in")
    corpus.txt_to_csv(spark, f"{path}/in", f"{path}/out.csv")
    return corpus.read_csv(spark, f"{path}/out.csv", ["n_name", "k"], header=False)


@query("select n_name, n_regionkey::varchar k from nation union all select r_name, '' from region")
def csv_crawl(spark, d):
    """All .csv files below a folder, whatever their depth."""
    path = scratch(spark, "crawl")
    corpus.write_csv(table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("k")), f"{path}/a", header=False)
    corpus.write_csv(table(spark, d, "region").select("r_name", F.lit("").alias("k")), f"{path}/b/c", header=False)
    files = [r["path"] for r in corpus.csv_files(spark, path).collect()]
    return corpus.read_csv(spark, files, ["n_name", "k"], header=False).withColumn("k", F.coalesce("k", F.lit("")))


@query("""select unionid, colid, s.o + rowid rowid, tokenized from (select distinct tableid, colid, rowid, tokenized from main_tokenized) c
 join (select tableid, unionid, coalesce(sum(n) over (partition by unionid order by tableid rows between unbounded preceding and 1 preceding), 0) o from (select tableid, max(rowid) + 1 n from main_tokenized group by 1) join (select distinct * from union_tables_new) using (tableid)) s using (tableid)""")
def union_tables(spark, d):
    return corpus.union_tables(table(spark, d, "main_tokenized"), table(spark, d, "union_tables_new"))


@query("select term, idf from inverse_document_frequency where term in (select v from rows0 union select k from rows0)")
def idf_lookup(spark, d):
    r = rows0(spark, d)
    return corpus.idf_of(table(spark, d, "inverse_document_frequency"), r.select(F.col("k").alias("term")).union(r.select("v")))


@query("select tableid, tokenized, arg_min(term, (colid, rowid)) term from cells where tokenized <> '' and term is not null group by tableid, tokenized")
def untokenize(spark, d):
    return corpus.untokenize(table(spark, d, "main_tokenized"))


_PARTS = "union all select p_partkey, 1, case when length(p_brand) <= 100 then p_brand end from part union all select p_partkey, 2, p_type from part"


@query(f"select tableid, colid, 0 rowid, term, array_to_string(list_filter(regexp_extract_all(lower(term), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x not in {text.STOP_WORDS}), ' ') tokenized from (select p_partkey tableid, 0 colid, p_name term from part {_PARTS})")
def ingest_cells(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.array("p_name"), F.array("p_brand"), F.array("p_type")).alias("relation"))
    return corpus.ingest_cells(raw)


_DUMP = """(select r_regionkey + 1 id, r_name, list(n_name order by n_nationkey) ns, list(n_nationkey order by n_nationkey) ks from region join nation on n_regionkey = r_regionkey group by all)"""


def _ingested(spark, d) -> corpus.Relations:
    """Each region as a table of a gzipped dump: a column of nations and one of their keys, with a header."""
    path = scratch(spark, "dump")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    column = lambda name, f: F.concat(F.array(F.lit(name)), F.transform("l", f))
    raw = g.select("r_regionkey", F.array(column("nation", lambda x: x["n_name"]), column("key", lambda x: x["n_nationkey"].cast("string"))).alias("relation"), F.lit(True).alias("hasHeader"), F.concat(F.lit("http://www.Stats.test/"), "r_name").alias("url"), F.col("r_name").alias("title"), F.array("r_name", F.lit("the nations")).alias("termSet"))
    raw = raw.coalesce(1).sortWithinPartitions("r_regionkey").drop("r_regionkey")
    raw.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("not json",), ('{"relation": [["one", "column"]]}',)], "value string")).coalesce(1).write.text(path, compression="gzip")
    return corpus.ingest(written(corpus.read_dump(spark, path), "raw"))


@query(f"select id, len(ns)::int numrows, 'www.stats.test' \"domain\", r_name title, lower(r_name) title_tokenized, concat(r_name, ' the nations') context, 0.5::double confidence from {_DUMP}")
def ingest_tables(spark, d):
    return _ingested(spark, d).tables.select("id", "numrows", "domain", "title", "title_tokenized", "context", F.col("confidence").cast("double").alias("confidence"))


@query(f"select id tableid, i colid, h header, h header_tokenized from {_DUMP}, (values (0, 'key'), (1, 'nation')) t(i, h)")
def ingest_columns(spark, d):
    return _ingested(spark, d).columns


@query(f"select id tableid, 0 colid, unnest(range(len(ks)))::int rowid, unnest(ks)::varchar term from {_DUMP} union all select id, 1, unnest(range(len(ns)))::int, unnest(ns) from {_DUMP}")
def ingest_table_cells(spark, d):
    return _ingested(spark, d).cells.select("tableid", "colid", "rowid", "term")


@query(f"select 'first' step, count(*) n_cells, count(distinct id) n_tables from (select id, unnest(ks) from {_DUMP} union all select id, unnest(ns) from {_DUMP}) union all select 'added', 2 * count(*), 2 * count(distinct id) from (select id, unnest(ks) from {_DUMP} union all select id, unnest(ns) from {_DUMP}) union all select 'removed', count(*), count(distinct id) from (select id, unnest(ks) from {_DUMP} union all select id, unnest(ns) from {_DUMP})")
def add_remove_tables(spark, d):
    """A stored corpus; the same tables under other ids added by a user; those removed again."""
    r = _ingested(spark, d)
    store = corpus.Store(spark, scratch(spark, "store"))
    steps = []

    def look(step):
        c = store.read("cells")
        steps.append((step, *c.agg(F.count("*"), F.count_distinct("tableid")).first()))

    store.add(r)
    look("first")
    other = lambda df, k: df.withColumn(k, F.col(k) + 100)
    store.add(corpus.Relations(other(r.tables, "id"), other(r.columns, "tableid"), other(r.cells, "tableid")), source=2, confidence=0.8)
    look("added")
    store.remove_added()
    look("removed")
    return spark.createDataFrame(steps, "step string, n_cells long, n_tables long")


@query("select n_nationkey id, case when n_name < cast(n_regionkey as varchar) then n_name else cast(n_regionkey as varchar) end first_header from nation")
def extract_table(spark, d):
    rel = F.array(F.array(F.col("n_name"), F.lit("a")), F.array(F.col("n_regionkey").cast("string"), F.lit("b")), F.array(F.lit(""), F.lit("c")))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), corpus.extract_table(rel, F.lit(True))[0][0].alias("first_header"))


@query("select tableid, count(*) n from cells where tableid not in (select id from new_tables_tokenized_full where source > 1) group by tableid")
def remove_added(spark, d):
    return corpus.remove_added(table(spark, d, "new_tables_tokenized_full"), cells(spark, d)).groupBy("tableid").agg(F.count("*").alias("n"))


@query("select tokenized term, count(distinct tableid) number_occurence, round(ln((select count(distinct tableid) from main_tokenized) // count(distinct tableid)), 6) idf from u group by tokenized")
def idf(spark, d):
    return _rounded(corpus.idf(table(spark, d, "main_tokenized")), "idf")


@query("select w term, count(*) n from (select unnest(string_split(context_tokenized, ' ')) w from new_tables_tokenized_full where context_tokenized <> '') group by w")
def term_counts(spark, d):
    """Term sets of all tables, counted and written as lines, read back."""
    path = scratch(spark, "counts")
    raw = table(spark, d, "new_tables_tokenized_full").where("context_tokenized <> ''").select(F.split("context_tokenized", " ").alias("termSet"))
    corpus.term_set_counts(raw).write.csv(path, sep="|", emptyValue="")
    return spark.read.schema("term string, n long").csv(path, sep="|")


@query("select replace(coalesce(nullif(trim(domain), ''), 'none'), '.', '-') \"domain\", count(*) n from (select distinct id, domain from new_tables_tokenized_full) group by 1")
def split_domain(spark, d):
    """One folder of gzipped lines per domain, read back."""
    path = scratch(spark, "by-domain")
    rows = table(spark, d, "new_tables_tokenized_full").select("id", "domain").distinct()
    corpus.write_by_domain(rows.select(F.nullif(F.trim("domain"), F.lit("")).alias("domain"), F.col("id").cast("string").alias("line")), path)
    return spark.read.schema("value string, domain string").text(path).groupBy("domain").agg(F.count("*").alias("n"))


@query("select id, host, row_number() over (order by host, id) tableid from (select distinct id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) host from new_tables_tokenized_full) where host <> ''")
def export_by_host(spark, d):
    """JSON lines in one folder per host, with a running tableid, read back."""
    path = scratch(spark, "by-host")
    t = table(spark, d, "new_tables_tokenized_full").select("id", text.url_host(F.coalesce("url", F.lit(""))).alias("host")).where("host <> ''").distinct()
    n = corpus.numbered(t, ["host", "id"], "tableid", 1)
    n.select("host", F.to_json(F.struct("id", "tableid")).alias("value")).write.partitionBy("host").text(path, compression="gzip")
    back = spark.read.schema("value string, host string").text(path)
    return back.select(F.from_json("value", "id long, tableid long").alias("j"), "host").select("j.id", "host", "j.tableid")


@query("select concat('n', n_nationkey) subject, 'name' predicate, n_name object, lower(n_name) object_tokenized from nation")
def load_triples(spark, d):
    lines = table(spark, d, "nation").select(F.concat(F.lit("<n"), "n_nationkey", F.lit('> <name> "'), "n_name", F.lit('" .')).alias("value"))
    return corpus.parse_triples(lines)


@query("select tokenized, count(distinct tableid) n_tables, count(*) n_cells from u group by tokenized")
def inverted_index(spark, d):
    return graph.inverted_index(table(spark, d, "main_tokenized").select("tableid", "colid", "rowid", "term", "tokenized").distinct())


@query("select tableid, rowid, tokenized from cells where colid = 0 and rowid % 5 = 0")
def sample_every_n(spark, d):
    return cells(spark, d).where("colid = 0 and rowid % 5 = 0").select("tableid", "rowid", "tokenized")


@query("select distinct tokenized from cells where colid = 0")
def project_distinct(spark, d):
    return table(spark, d, "main_tokenized").where("colid = 0").select("tokenized").distinct()


@query("select a.tableid, a.rowid, concat(a.tokenized, '|', b.tokenized) k from u a join u b on a.tableid = b.tableid and a.rowid = b.rowid where a.colid = 0 and b.colid = 1")
def project_key(spark, d):
    c = search.usable(table(spark, d, "main_tokenized").where("colid in (0, 1)"))
    a, b = c.where("colid = 0").select("tableid", "rowid", F.col("tokenized").alias("a")), c.where("colid = 1").select("tableid", "rowid", F.col("tokenized").alias("b"))
    return a.join(b, ["tableid", "rowid"]).select("tableid", "rowid", F.concat_ws("|", "a", "b").alias("k"))


@query("select n_name, null::varchar added from nation")
def add_drop_col(spark, d):
    return table(spark, d, "nation").withColumn("added", F.lit(None).cast("string")).drop("n_nationkey", "n_regionkey")


@query("select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def retain_rows(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("select c_name name, c_nationkey nationkey from customer union all select s_name, s_nationkey from supplier")
def concat(spark, d):
    c = table(spark, d, "customer").selectExpr("c_name name", "c_nationkey nationkey")
    return c.unionAll(table(spark, d, "supplier").selectExpr("s_name name", "s_nationkey nationkey"))


@query("select a from (select distinct n_name a from nation intersect select distinct upper(n_name) from nation) union all (select r_name from region except select n_name from nation)")
def set_ops(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("a"))
    r = table(spark, d, "region").select(F.col("r_name").alias("a"))
    return n.intersect(n.select(F.upper("a").alias("a"))).unionAll(r.subtract(n))


@query(r"select distinct term, case when regexp_full_match(term, '(&nbsp;|\?|\s|-)*') or lower(trim(term)) = 'null' then null else trim(regexp_replace(replace(term, '&nbsp;', ' '), '\s+', ' ', 'g')) end clean from main_tokenized where term is not null")
def normalize_cell(spark, d):
    return table(spark, d, "main_tokenized").where("term is not null").select("term").distinct().select("term", text.normalize_cell(F.col("term")).alias("clean"))


@query("select a.n_name a, b.n_name b, a.n_nationkey < b.n_nationkey less from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name where levenshtein(a.n_name, b.n_name) <= 3")
def similar_cells(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a"), F.col("n_nationkey").alias("ak")), n.select("n_regionkey", F.col("n_name").alias("b"), F.col("n_nationkey").alias("bk"))
    return a.join(b, "n_regionkey").where((F.col("a") != F.col("b")) & F.levenshtein("a", "b", 3).between(0, 3)).select("a", "b", (F.col("ak") < F.col("bk")).alias("less"))


@query("select tableid, bool_or(not regexp_full_match(coalesce(header, ''), 'COLUMN\\d+')) has_header from columns_tokenized group by tableid")
def has_header(spark, d):
    return table(spark, d, "columns_tokenized").groupBy("tableid").agg(F.bool_or(~F.coalesce("header", F.lit("")).rlike(r"^COLUMN\d+$")).alias("has_header"))


_SQL_TYPES = (
    ("NUMBER", r"(\s|&nbsp;)*-?(\s|&nbsp;)*([0-9]+(\.[0-9]+)?|[0]*\.[0-9]+)((\s|&nbsp;)?%)?(\s|&nbsp;)*"),
    ("DATE", r"(\s|&nbsp;)*[0-3]?[0-9](-|/|.)[0-3]?[0-9](-|/|.)([0-9]{2})?[0-9]{2}(\s|&nbsp;)*"),
    ("CURRENCY", r"(\s|&nbsp;)*(\$|€|EUR|USD|CAD|C\$)( )?\d+ | \d+( )?(\$|€|EUR|USD|CAD|C\$)(\s|&nbsp;)*"),
)


def _type_sql(c: str, where: str) -> str:
    tests = " ".join(f"when bool_and(regexp_full_match({c}, '{p}')) filter (where {where}) then '{n}'" for n, p in _SQL_TYPES)
    return f"case when count({c}) filter (where {where}) = 0 then null {tests} else 'STRING' end"


@query(f"select tableid, colid, {_type_sql('term', 'term is not null')} as type from cells group by tableid, colid")
def infer_types(spark, d):
    return corpus.column_types(cells(spark, d))


@query(f"""select t.tableid, case when coalesce(colon, false) then 1 when r0 = 'STRING' and coalesce(rx, false) then 1 when c0 = 'STRING' and coalesce(cx, false) then 2 else 0 end header from (select distinct tableid from cells where term is not null) t
 left join (select tableid, count(*) filter (where regexp_matches(term, ':[^a-zA-Z0-9_]*$')) >= 0.75 * count(*) colon, {_type_sql('term', 'true')} r0 from cells where term is not null and rowid = 0 group by 1) using (tableid)
 left join (select tableid, bool_or(ty <> 'STRING') rx from (select tableid, colid, {_type_sql('term', 'true')} ty from cells where term is not null group by 1, 2) group by 1) using (tableid)
 left join (select tableid, {_type_sql('term', 'true')} c0 from cells where term is not null and colid = 0 group by 1) using (tableid)
 left join (select tableid, bool_or(ty <> 'STRING') cx from (select tableid, rowid, {_type_sql('term', 'true')} ty from cells where term is not null and colid > 0 group by 1, 2) group by 1) using (tableid)""")
def detect_header(spark, d):
    return corpus.detect_header(cells(spark, d))


@query("select distinct id from new_tables_tokenized_full where source = 1")
def original_only(spark, d):
    return table(spark, d, "new_tables_tokenized_full").where("source = 1").select("id").distinct()


@query("select k, case when i <= 3 then v end v from (select *, row_number() over (order by rowid, k) i from rows0)")
def make_input(spark, d):
    return evaluate.make_input(rows0(spark, d), GIVEN).select("k", "v")


@query("select v is not null known, count(*) n from (select case when i <= 3 then v end v from (select *, row_number() over (order by rowid, k) i from rows0)) group by 1")
def known_unknown(spark, d):
    r = evaluate.make_input(rows0(spark, d), GIVEN)
    return r.groupBy(F.col("v").isNotNull().alias("known")).agg(F.count("*").alias("n"))


# search


@query("select * from matches")
def find_tables(spark, d):
    return matches(spark, d)


@query("select tableid, colid x_col from xcol")
def find_x_tables(spark, d):
    k = _tok(rows0(spark, d), "k").select(F.lit(0).alias("pos"), "tokenized")
    return search.matching_columns(rest(spark, d), k, LEAST).select("tableid", F.col("colid").alias("x_col"))


@query("select * from matches")
def find_tables_by_token(spark, d):
    """find_tables over the copy of the cells that is sorted by token: the scan skips the row groups without an example."""
    e = examples(spark, d)
    path = scratch(spark, "by-token")
    corpus.write_by_token(rest(spark, d), path, parallelism(spark))
    return search.find_tables(spark.read.parquet(path), _tok(e, "k"), _tok(e, "v"), LEAST)


_T3 = "(select min(tableid) from u where colid = 2 and tableid >= 1000)"


@query(f", own as (select distinct colid, tokenized from u where tableid = {_T3}) select distinct a.tableid, a.colid x0, b.colid x1, y.colid y0 from u a join u b on a.tableid = b.tableid and a.rowid = b.rowid and a.colid <> b.colid join (select tableid, colid from u where tokenized in (select tokenized from own where colid = 2) group by all having count(distinct tokenized) >= 2) y on y.tableid = a.tableid and y.colid <> a.colid and y.colid <> b.colid where a.tokenized in (select tokenized from own where colid = 0) and b.tokenized in (select tokenized from own where colid = 1) order by all limit 1000")
def find_tables_multi(spark, d):
    """Two X columns in one row, one Y column: those of the first ordinary table with three columns, in the whole corpus."""
    c = table(spark, d, "main_tokenized").where("tokenized <> ''")
    own = c.where(F.col("tableid") == F.lit(c.where(f"colid = 2 and tableid >= {FIRST}").agg(F.min("tableid")).first()[0]))
    x0, x1, y = (_tok(own.where(F.col("colid") == i), "tokenized") for i in range(3))
    return search.find_tables_multi(c, [x0, x1], [y], LEAST)


@query("select * from matches order by all limit 1000")
def similar_find_tables(spark, d):
    """The entry with parallel lists of inputs and outputs, validated."""
    e = [(r["k"], r["v"]) for r in examples(spark, d).collect()]
    found = search.similar_find_tables(rest(spark, d), [k for k, _ in e], [v for _, v in e], LEAST)
    return found.select("tableid", F.col("x0").alias("x_col"), F.col("y0").alias("y_col"))


_UN = "(select unionid, colid, tokenized from u join (select distinct * from union_tables_new) using (tableid))"


@query(f"select x.unionid, x.colid x0, y.colid y0 from (select unionid, colid from {_UN} where tokenized in (select tokenized from big where colid = 0) group by all having count(distinct tokenized) >= 2) x join (select unionid, colid from {_UN} where tokenized in (select tokenized from big where colid = 1) group by all having count(distinct tokenized) >= 2) y on x.unionid = y.unionid and x.colid <> y.colid order by all limit 1000".replace("select x.unionid", ", big as (select distinct colid, tokenized from u where colid in (0, 1) and tableid = (select min(tableid) from union_tables_new where unionid in (select unionid from union_tables_new group by unionid having count(distinct tableid) > 1) and tableid in (select tableid from u where colid = 1 group by 1 having count(distinct tokenized) > 1) and tableid in (select tableid from u where colid = 0 group by 1 having count(distinct tokenized) > 1))) select x.unionid", 1))
def find_tables_union(spark, d):
    """The columns of the first member of a union of several tables, searched for in all unions."""
    m = table(spark, d, "union_tables_new").distinct()
    cells_ = table(spark, d, "main_tokenized")
    several = m.groupBy("unionid").agg(F.count_distinct("tableid").alias("n")).where("n > 1").select("unionid")
    with_y = cells_.where("colid in (0, 1) and tokenized <> ''").groupBy("tableid", "colid").agg(F.count_distinct("tokenized").alias("n")).where("n > 1").groupBy("tableid").count().where("count = 2").select("tableid")
    first = m.join(several, "unionid", "left_semi").join(with_y, "tableid", "left_semi").agg(F.min("tableid")).first()[0]
    own = cells_.where((F.col("tableid") == F.lit(first)) & (F.col("tokenized") != ""))
    x, y = (_tok(own.where(F.col("colid") == i), "tokenized") for i in (0, 1))
    return search.find_tables_multi(cells_.join(m, "tableid"), [x], [y], LEAST, key="unionid", by_row=False)


_PAIRS = "(select a.tableid, a.rowid, a.colid xc, b.colid yc, k, v from uc a join (select distinct k, v from rows0) r on r.k = a.tokenized join uc b on b.tableid = a.tableid and b.rowid = a.rowid and b.colid <> a.colid and b.tokenized = r.v)"


@query(f"select tableid, xc x_col, yc y_col, count(*) n from {_PAIRS} where (k, v) in (select (k, v) from ex) group by all having count(*) >= 2")
def find_row_aligned(spark, d):
    return search.find_row_aligned(rest(spark, d), examples(spark, d).select(F.col("k").alias("x"), F.col("v").alias("y")), LEAST)


#: DuckDB's edit distance counts bytes: characters beyond ASCII are mapped one to one to ASCII ones that no token has.
_ODD = ", odd as (select coalesce(string_agg(c, '' order by c), '') cs from (select distinct unnest(regexp_extract_all(tokenized, '[^ -~]')) c from u)), flat as (select tokenized, translate(tokenized, (select cs from odd), (select string_agg(chr(i::int), '' order by i) from (select unnest(list_concat(range(1, 32), range(65, 91), [33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 58, 59, 60, 61, 62, 63, 64, 91, 92, 93, 94, 96, 123, 124, 125, 126])) i))) f from (select distinct tokenized from u))"
_FUZZY = "select w, tokenized, distance from (select *, row_number() over (partition by w order by distance, tokenized) i from (select r.k w, t.tokenized, levenshtein(a.f, t.f) distance from (select distinct k from rows0 where length(k) >= 5) r join flat a on a.tokenized = r.k join (select * from flat where tokenized in (select tokenized from uc)) t on levenshtein(a.f, t.f) <= least(2, ceil(0.2 * length(r.k))))) where i <= 100"


@query(f"{_ODD} {_FUZZY}")
def fuzzy_terms(spark, d):
    return search.fuzzy_terms(rest(spark, d), rows0(spark, d).select(F.col("k").alias("w")))


def _wide_sql(c: str) -> str:
    return f"(select tokenized from (select *, row_number() over (partition by w order by distance, tokenized) i from (select r.w, t.tokenized, levenshtein(a.f, t.f) distance from (select distinct {c} w from ex where length({c}) >= 5) r join flat a on a.tokenized = r.w join flat t on levenshtein(a.f, t.f) <= least(2, ceil(0.2 * length(r.w))) where t.tokenized in (select tokenized from uc))) where i <= 100 union select {c} from ex)"


@query(f"{_ODD}, wx as (select * from {_wide_sql('k')}), wy as (select * from {_wide_sql('v')}), fx as (select tableid, colid from uc where tokenized in (select tokenized from wx) group by all having count(distinct tokenized) >= 2), fy as (select tableid, colid from uc where tokenized in (select tokenized from wy) group by all having count(distinct tokenized) >= 2) select x.tableid, x.colid x_col, y.colid y_col from fx x join fy y on x.tableid = y.tableid and x.colid <> y.colid")
def find_tables_fuzzy(spark, d):
    e = examples(spark, d)
    return search.find_tables_fuzzy(rest(spark, d), _tok(e, "k"), _tok(e, "v"), LEAST)


@query("select distinct v, substr(v, i, n) s from (select n_name v from nation where length(n_name) > 3), range(1, 40) t(i), range(4, 40) q(n) where i + n - 1 <= length(v)")
def substrings(spark, d):
    return search.substrings(table(spark, d, "nation").select(F.col("n_name").alias("v")))


_FT = "select tableid, sum(w) s, count(*) n from (select distinct u.tableid, u.tokenized, coalesce(i.w, 0) w from uc u left join widf i on i.term = u.tokenized where u.tokenized in (select {0} from {1})) group by tableid"
_META = "(select distinct t.id tableid, unnest(regexp_extract_all(lower(concat_ws(' ', title, context)), '[\\p{L}\\p{N}_]+')) w from new_tables_tokenized_full t)"


@query(f""", widf as (select term, least(max(idf), 30) w from inverse_document_frequency where isfinite(idf) and idf > 0 group by term),
 fx as (select * from ({_FT.format('k', 'rows0')}) where n >= 2), fy as (select * from ({_FT.format('v', 'ex')}) where n >= 1),
 words as (select distinct unnest(string_split(k, ' ')) w from rows0),
 h as (select tableid, count(distinct header_tokenized) n from columns_tokenized where header_tokenized in (select h from head where tableid = (select id from t0) and colid in (0, 1)) group by 1),
 m as (select tableid, count(distinct w) n from {_META} where w in (select w from words) group by 1)
 select fx.tableid, fx.n n_keys, fy.n n_values, coalesce(h.n, 0) n_headers, coalesce(m.n, 0) n_around, round(fx.s + fy.s + 0.25 * coalesce(h.n, 0) + 0.1 * coalesce(m.n, 0), 6) score from fx join fy using (tableid) left join h using (tableid) left join m using (tableid) order by score desc, tableid limit 1000""")
def fulltext_tables(spark, d):
    t = table(spark, d, "new_tables_tokenized_full").select(F.col("id").alias("tableid"), "title", "context")
    own = [r[0] for r in table(spark, d, "columns_tokenized").where((F.col("tableid") == F.lit(_t0(spark, d))) & F.col("colid").isin(0, 1)).groupBy("colid").agg(F.min("header_tokenized")).select(F.col("min(header_tokenized)")).where("`min(header_tokenized)` is not null").collect()]
    return search.fulltext_tables(rest(spark, d), table(spark, d, "columns_tokenized"), t, table(spark, d, "inverse_document_frequency"), _tok(rows0(spark, d), "k"), _tok(examples(spark, d), "v"), own, LEAST, 1)


_XY = "(select distinct a.k x, b.k y from rows0 a join rows0 b on a.k < b.k)"


@query(f"select x, y, count(*) n from {_XY} p join (select distinct tableid, colid, tokenized from uc) a on a.tokenized = x join (select distinct tableid, colid, tokenized from uc) b on b.tokenized = y and a.tableid = b.tableid and a.colid = b.colid group by x, y")
def cooccurrence(spark, d):
    k = rows0(spark, d).select("k").distinct()
    p = k.withColumnRenamed("k", "x").join(k.withColumnRenamed("k", "y"), F.col("x") < F.col("y"))
    return search.cooccurrence(rest(spark, d), p)


@query("select tableid, colid x_col from xcol where tableid not in (select tableid from matches)")
def table_difference(spark, d):
    """Tables that hold the input's keys, without those the search by examples has seen."""
    return search.table_difference(find_x_tables(spark, d), matches(spark, d))


@query(f"select distinct k x, v y from {_PAIRS}")
def present_in_corpus(spark, d):
    return search.present_in_corpus(rest(spark, d), rows0(spark, d).select(F.col("k").alias("x"), F.col("v").alias("y")))


@query(f"select distinct k x, v y from {_PAIRS} where tableid in (select id from new_tables_tokenized_full where numrows > 3)")
def present_in_larger_tables(spark, d):
    sizes = table(spark, d, "new_tables_tokenized_full").select(F.col("id").alias("tableid"), "numrows")
    return search.present_in_corpus(rest(spark, d), rows0(spark, d).select(F.col("k").alias("x"), F.col("v").alias("y")), sizes)


def _freqx(most: bool):
    order = "desc" if most else "asc"

    def f(spark, d):
        return search.policy_by_frequency(rest(spark, d), _tok(rows0(spark, d), "k"), 5, most)

    f.__name__ = f"policy_{'most' if most else 'least'}_freqx"
    query(f"select tokenized, count(distinct (tableid, colid)) n_cols from uc where tokenized in (select k from rows0) group by 1 order by n_cols {order}, tokenized limit 5")(f)


def _freqpair(most: bool):
    order = "desc" if most else "asc"

    def f(spark, d):
        return search.policy_by_pairs(rest(spark, d), rows0(spark, d).select(F.col("k").alias("x"), F.col("v").alias("y")), 5, most)

    f.__name__ = f"policy_{'most' if most else 'least'}_freqpair"
    query(f"select x, y, n_tables from (select *, row_number() over (partition by x order by n_tables {order}, y) i from (select k x, v y, count(distinct tableid) n_tables from {_PAIRS} group by all)) where i = 1 order by n_tables {order}, x limit 5")(f)


for _m in (True, False):
    _freqx(_m)
    _freqpair(_m)

_SC = "(select concat('k', c_custkey % 97) x, concat(c_mktsegment, c_custkey % 3) y, max((c_custkey * 7919 % 100 + 1) / 100.0::double) score from customer group by 1, 2)"


def _certain(policy: str, sql: str):
    def f(spark, d):
        c = F.col("c_custkey").cast("long")
        e = table(spark, d, "customer").groupBy(F.concat(F.lit("k"), c % 97).alias("x"), F.concat("c_mktsegment", c % 3).alias("y")).agg(F.max((c * 7919 % 100 + 1) / 100.0).alias("score"))
        # fewer than 300 keys are certain: the 300 best pairs take their place
        return search.policy_certain(e, "fill", 300) if policy == "fill_short" else search.policy_certain(e, policy, 10)

    f.__name__ = f"policy_{policy}" if policy.startswith("most") else f"policy_certain_{policy}"
    query(sql)(f)


_TOPX = f"(select x from {_SC} group by x order by max(score) desc, x limit 10)"
_certain("most_certain", f"select x, y, score from {_SC} where x in {_TOPX}")
_certain("pairs", f"select x, y, score from {_SC} order by score desc, x, y limit 10")
_certain("xs", f"select x, y, score from (select *, row_number() over (partition by x order by score desc, y) i from {_SC} where x in {_TOPX}) where i <= 2")
_certain("only", f"select x, y, score from {_SC} where score = 1.0")
_certain("fill_short", f"select x, y, score from {_SC} order by score desc, x, y limit 300")
_certain("fill", f"select x, y, score from {_SC} where score = 1.0 and (select count(distinct x) from {_SC} where score = 1.0) >= 10 union all select * from (select x, y, score from {_SC} where (select count(distinct x) from {_SC} where score = 1.0) < 10 order by score desc, x, y limit 10)")


# checking, scoring, iteration


@query("select tableid, x_col, y_col, k, v, n from mapped")
def table_map(spark, d):
    return mapped(spark, d)


@query("select mid, k, v from ans")
def answers(spark, d):
    return ans(spark, d)


@query("select mid, sum(good) good, sum(bad) bad from checked group by mid")
def check_mapping(spark, d):
    return score.check(cand(spark, d), examples(spark, d)).groupBy("mid").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query("select mid, k, good, bad, n_good from checked")
def check_mapping_keyed(spark, d):
    return score.check(cand(spark, d), examples(spark, d))


@query(f", {_WIDE} select k, v from wbad")
def check_mapping_func(spark, d):
    return score.bad_pairs(wide(spark, d), examples(spark, d))


@query("select mid, k, good, 0.0::double bad, n_good from checked")
def check_mapping_nonfunc(spark, d):
    return score.check(cand(spark, d), examples(spark, d), "nonfunctional")


_FORM = "(select e.{0}, c.{0} form, 1 - levenshtein(fe.f, fc.f)::double / greatest(length(fe.f), length(fc.f)) sim from (select distinct {0} from ex where length({0}) >= 5) e join (select distinct {0} from cand) c on c.{0} <> e.{0} join flat fe on fe.tokenized = e.{0} join flat fc on fc.tokenized = c.{0} where levenshtein(fe.f, fc.f) <= least(2, ceil(0.2 * length(e.{0}))))"


@query(f"{_ODD}, vf as (select * from {_FORM.format('v')}), kf as (select * from {_FORM.format('k')}), e1 as (select k, v, score from ex union all select ex.k, form, score * sim from ex join vf using (v)), e2 as (select k, v, max(score) score from (select * from e1 union all select form, v, score * sim from e1 join kf using (k)) group by all) select a.mid, a.k, sum(coalesce(e.score, 0.0)) good, sum(case when e.score is null then 1.0 else 0.0 end) bad, count(e.score) n_good from cand a left join e2 e on e.k = a.k and e.v = a.v where a.k in (select k from e2) group by a.mid, a.k")
def check_mapping_fuzzy(spark, d):
    a, e = cand(spark, d), examples(spark, d)

    def forms_of(c: str) -> DataFrame:
        near = search.fuzzy_terms(_tok(a, c), e.select(F.col(c).alias("w"))).where("distance > 0")
        return near.select(F.col("w").alias(c), F.col("tokenized").alias("form"), text.similarity(F.col("w"), F.col("tokenized")).alias("sim"))

    return score.check_fuzzy(a, e, forms_of("v"), forms_of("k"))


@query("select a.mid, a.k, sum(case when b.v is not null then e.score else 0.0 end) present, sum(case when b.v is null then e.score else 0.0 end) absent from (select distinct mid, k from cand) a join ex e on e.k = a.k left join cand b on b.mid = a.mid and b.k = e.k and b.v = e.v group by a.mid, a.k")
def local_completeness(spark, d):
    return score.local_completeness(cand(spark, d), examples(spark, d))


@query("select mid, sum(n_good)::bigint n_good, round(coalesce(sum(good) / nullif(sum(good) + sum(bad), 0), 0), 6) correctness from checked group by mid having sum(n_good) >= 1 and coalesce(sum(good) / nullif(sum(good) + sum(bad), 0), 0) >= 0.3")
def assess(spark, d):
    return _rounded(score.assess(score.check(cand(spark, d), examples(spark, d)), 1), "correctness")


@query("select mid, sum(n_good * n_good)::bigint n_good, round(coalesce(sum(c * w) / nullif(sum(w), 0), 0), 6) correctness from (select mid, n_good, coalesce(good / nullif(good + bad, 0), 0) c, good + bad w from checked) group by mid having sum(n_good * n_good) >= 1 and coalesce(sum(c * w) / nullif(sum(w), 0), 0) >= 0.3")
def assess_weighted(spark, d):
    return _rounded(score.assess_weighted(score.check(cand(spark, d), examples(spark, d)), 1), "correctness")


@query(f", {_WIDE}, kb as (select k, v from wbad where v > 'm') select a.mid, a.k, sum(coalesce(e.score, 0.0)) good, sum(case when e.score is null then 1.0 else 0.0 end + case when (a.k, a.v) in (select (k, v) from kb) then 1.0 else 0.0 end) bad, count(e.score) n_good from wide a left join ex e on e.k = a.k and e.v = a.v where a.k in (select k from ex) group by a.mid, a.k")
def check_mapping_known_bad(spark, d):
    """A contradiction that is known already counts twice."""
    a, e = wide(spark, d), examples(spark, d)
    return score.check(a, e, "functional", score.bad_pairs(a, e).where("v > 'm'"))


@query(f", {_WIDE}, wc as (select mid, a.k, count(e.score) n from wide a left join ex e on e.k = a.k and e.v = a.v where a.k in (select k from ex) group by mid, a.k), lc as (select a.mid, sum(case when b.v is not null then e.score else 0.0 end) p, sum(e.score) t from (select distinct mid, k from wide) a join ex e on e.k = a.k left join wide b on b.mid = a.mid and b.k = e.k and b.v = e.v group by a.mid) select mid, sum(n * n)::bigint n_good from wc where mid in (select mid from lc where p >= 0.3 * t) group by mid having sum(n * n) >= 1")
def assess_open(spark, d):
    a, e = wide(spark, d), examples(spark, d)
    return score.assess_open(score.check(a, e, "nonfunctional"), score.local_completeness(a, e), 1)


@query("select distinct mid, k, v from (select mid, k, v from ans union all select 'query', k, v from ex) a where not exists (select 1 from bad b where b.k = a.k and b.v = a.v)")
def consolidate(spark, d):
    found, e = cand(spark, d), examples(spark, d)
    return score.consolidate(ans(spark, d, found), e.select(F.lit("query").alias("mid"), "k", "v"), score.bad_pairs(found, e))


@query("select concat(m.tableid, ':', m.x_col, ':', m.y_col) mid, round(s, 6) \"schema\" from matches m join hdr using (tableid, x_col, y_col)")
def schema_match(spark, d):
    return _rounded(_schema(spark, d, matches(spark, d)), "schema")


def _ratings(spark, d, a=None):
    a = ans(spark, d) if a is None else a
    return written(score.rating(a, examples(spark, d), tabs(spark, d, a)), "ratings")


@query("select mid, round(rating, 6) rating from rat")
def rating(spark, d):
    return _rounded(_ratings(spark, d), "rating")


_NBAD = "(select mid, count(*) n_bad from ans join bad using (k, v) group by mid)"


@query(f"select mid, round(coalesce((good + prior * unseen) * 0.99 / nullif(total + unseen + 10 * coalesce(n_bad, 0), 0), 0), 6) rating from evid join tabs using (mid) left join {_NBAD} using (mid)")
def rating_indirect(spark, d):
    found, e = cand(spark, d), examples(spark, d)
    a = ans(spark, d, found)
    return _rounded(score.rating_indirect(a, e, tabs(spark, d, a), score.bad_pairs(found, e)), "rating")


_CTX = "(select a.mid, coalesce(sum(i.idf), 0) context from (select distinct mid, tableid from ans) a left join (select distinct u.tableid, i.term, i.idf from uc u join inverse_document_frequency i on i.term = u.tokenized where i.term in (select k from ex) and isfinite(i.idf)) i using (tableid) group by a.mid)"


@query(f"select mid, rating from (select mid, round(coalesce((p * good - (1 - p) * 2 * coalesce(n_bad, 0)) * 0.99 / nullif(total + (1 - p) * unseen, 0), 0), 6) rating from (select e.*, n_bad, least(prior * (1 + exp(-0.1 * context)), 1) p from evid e join tabs using (mid) join {_CTX} using (mid) left join {_NBAD} using (mid))) where rating > 0")
def rating_sets(spark, d):
    found, e = cand(spark, d), examples(spark, d)
    a = ans(spark, d, found)
    i = table(spark, d, "inverse_document_frequency").where("idf is not null and abs(idf) < double('infinity') and not isnan(idf)").select(F.col("term").alias("tokenized"), "idf").join(F.broadcast(e.select(F.col("k").alias("tokenized"))), "tokenized", "left_semi")
    ctx = search.holding(rest(spark, d).select("tableid", "tokenized"), i).distinct().groupBy(F.col("tableid").cast("string").alias("t")).agg(F.sum("idf").alias("c"))
    t = tabs(spark, d, a).withColumn("t", F.split("mid", ":")[0]).join(ctx, "t", "left").select("mid", "prior", F.coalesce("c", F.lit(0.0)).alias("context"))
    return _rounded(score.rating_sets(a, e, t, score.bad_pairs(found, e)), "rating").where("rating > 0")


@query(f"select mid, rating from (select mid, round(coalesce((prior * coalesce(g, 0) - (1 - prior) * 2 * coalesce(n_bad, 0)) * 0.99 / nullif(coalesce(g, 0) + coalesce(n_bad, 0), 0), 0), 6) rating from tabs left join (select mid, count(*) g from ans join (select k, v from ex) using (k, v) group by mid) using (mid) left join {_NBAD} using (mid)) where rating >= 0")
def rating_pruned(spark, d):
    found, e = cand(spark, d), examples(spark, d)
    a = ans(spark, d, found)
    return _rounded(score.rating_pruned(a, e, score.bad_pairs(found, e), tabs(spark, d, a)), "rating")


@query("select k, v, round(score, 6) score from scored")
def score_functional(spark, d):
    a = ans(spark, d)
    return _rounded(score.score_functional(a, _ratings(spark, d, a)), "score")


@query("select k, v, round(1 - product(1 - rating), 6) score from ar group by k, v")
def score_noisy_or(spark, d):
    a = ans(spark, d)
    return _rounded(score.score_noisy_or(a, _ratings(spark, d, a)), "score")


@query("select k, v, round(case when i = 1 then 0.5 + n * 0.5 / all_n else 0.0 end, 6) score from (select *, row_number() over (partition by k order by n desc, v) i from (select k, v, count(distinct mid) n from ans group by k, v)) join (select k, count(distinct mid) all_n from ans group by k) using (k)")
def score_majority(spark, d):
    return _rounded(score.score_majority(ans(spark, d)), "score")


_BEST = "(select k, v, score from (select *, row_number() over (partition by k order by round(score, 9) desc, v) i from {0}) where i = 1)"
#: The second round of the iteration over the first round's evidence, without another search.
_EM2 = ", ev3 as (select * from ev1)," + _RATED.format(i=3, p=1)


@query("select k, v, round(score, 6) score from ex1")
def em_1(spark, d):
    a = ans(spark, d)
    return _rounded(em.rounds(a, examples(spark, d), tabs(spark, d, a), 1)[1], "score")


@query(_EM2 + " select k, v, round(score, 6) score from ex3")
def em_2(spark, d):
    a = ans(spark, d)
    return _rounded(em.rounds(a, examples(spark, d), tabs(spark, d, a), 2)[1], "score")


@query()
def em_to_convergence(spark, d):
    a = ans(spark, d)
    return _rounded(em.run(a, examples(spark, d), tabs(spark, d, a))[1], "score")


@query(f"select k, v, round(score, 6) score from {_BEST.format('scored')} where k in (select k from rows0)")
def current_answer(spark, d):
    a = ans(spark, d)
    s = score.best_per_key(score.score_functional(a, _ratings(spark, d, a)))
    return _rounded(s.join(rows0(spark, d).select("k").distinct(), "k", "left_semi"), "score")


def induced(spark: SparkSession, d: str, most: int) -> em.Induced:
    return em.induce(rest(spark, d), rows0(spark, d).select("k"), examples(spark, d), lambda a: tabs(spark, d, a), LEAST, searches=SEARCHES, most=most, asked=ASKED)


_FINAL = f"ex{SEARCHES}"


@query(f"select r.k, b.v, round(coalesce(b.score, 0), 6) score from (select distinct k from rows0) r left join {_FINAL} b using (k)")
def transform(spark, d):
    """The flagship: search by the examples, accept, rate, score, search again with what was found; two rounds."""
    return _rounded(score.transform(rows0(spark, d), induced(spark, d, SEARCHES).examples), "score")


@query()
def transform_to_convergence(spark, d):
    """The same until the scores settle (at most 100 rounds)."""
    return _rounded(score.transform(rows0(spark, d), induced(spark, d, 100).examples), "score")


@query(f"select mid, k, v from ev{SEARCHES}")
def evidence(spark, d):
    """All accepted evidence after the second search."""
    return induced(spark, d, SEARCHES).evidence


@query(f", {_WIDE} select distinct k, v from wide where (k, v) not in (select (k, v) from wide where mid not in (select mid from wide join wbad using (k, v)))")
def prune_dangling(spark, d):
    """The answers that lose all support once the tables that contradict an example are removed."""
    a, e = wide(spark, d), examples(spark, d)
    return score.prune_dangling(a, a.join(score.bad_pairs(a, e), ["k", "v"], "left_semi").select("mid"))[1]


@query(f", {_WIDE} select mid, k, v from wide a where exists (select 1 from wide b where b.k = a.k and b.v = a.v and b.mid not in (select mid from wide join wbad using (k, v) group by mid having count(*) > 1))")
def prune_bad_only(spark, d):
    a = wide(spark, d)
    return score.prune_bad_only(a, score.bad_pairs(a, examples(spark, d)), 1)


@query("select distinct mid, k, v from (select mid, k, v from ans a where not exists (select 1 from bad b where b.k = a.k and b.v = a.v) union all select 'query', k, v from ex)")
def feedback(spark, d):
    found, e = cand(spark, d), examples(spark, d)
    a = ans(spark, d, found)
    return score.feedback(a, e, e, score.bad_pairs(found, e), "query")[0]


@query("select mid, round(prior + (1 - prior) * coalesce(n, 0) * 0.99 / (select count(*) from ans join (select k, v from ex) using (k, v)), 6) prior from tabs left join (select mid, count(*) n from ans join (select k, v from ex) using (k, v) group by mid) using (mid)")
def boost(spark, d):
    a = ans(spark, d)
    used = a.join(examples(spark, d).select("k", "v"), ["k", "v"], "left_semi").select("mid")
    return _rounded(score.boost(tabs(spark, d, a), used), "prior")


@query("select k, v, mid from (select *, row_number() over (partition by k, v order by round(rating, 9) desc, mid) i from ar where rating > 0) where i = 1")
def best_table(spark, d):
    a = ans(spark, d)
    return score.best_table(a, _ratings(spark, d, a).withColumn("rating", F.round("rating", 9)))


@query("select mid, round(rating, 6) rating from rat where rating <> 0 order by round(rating, 6) desc, mid limit 32")
def top_tables(spark, d):
    return score.top_tables(_rounded(_ratings(spark, d), "rating"))


@query("select distinct a.mid, a.k, a.v from cand a join ex e on (contains(a.k, e.k) or contains(e.k, a.k)) and (contains(a.v, e.v) or contains(e.v, a.v)) where levenshtein(a.k, e.k) <= 23 and levenshtein(a.v, e.v) <= 23")
def similar_example_tables(spark, d):
    return score.similar_examples(cand(spark, d), examples(spark, d))


def _truth_sql(rounds: int) -> str:
    steps = ["cl as (select s.mid, f.k, f.v, (w.mid is not null)::int said from (select distinct k, v from wide) f join (select distinct mid, k from wide) s using (k) left join wide w on w.mid = s.mid and w.k = f.k and w.v = f.v)", "p0 as (select k, v, avg(said) t from cl group by k, v)"]
    for i in range(1, rounds + 1):
        steps.append(f"q{i} as (select mid, (sum(t * said) + 50) / (sum(t) + 100) s, (sum((1 - t) * said) + 10) / (sum(1 - t) + 1010) f from cl join p{i - 1} using (k, v) group by mid), p{i} as (select k, v, 1 / (1 + exp(-sum(case when said = 1 then ln(s / f) else ln((1 - s) / (1 - f)) end))) t from cl join q{i} using (mid) group by k, v)")
    return f", {_WIDE}, " + ", ".join(steps) + f" select k, v, round(t, 6) truth from p{rounds}"


@query(_truth_sql(4))
def truth_discovery(spark, d):
    return _rounded(em.latent_truth(wide(spark, d), 4, 0.0), "truth")


PICKS = 5


def _select(policy: str, sql: str):
    def f(spark, d):
        a = wide(spark, d)
        r = rows0(spark, d)
        scored = score.score_majority(a) if policy == "xy_min_score" else score.score_noisy_or(a, a.select("mid", F.lit(0.3).alias("rating")).distinct()) if policy == "clustering" else a
        return score.select_pairs(a, scored, policy, PICKS, examples(spark, d), r)

    f.__name__ = f"select_{policy}"
    query(f", {_WIDE}{'' if sql.startswith(',') else ' '}{sql}")(f)


_N = "(select k, v, count(distinct mid) n from wide where (k, v) not in (select (k, v) from ex) group by k, v)"
_MAJ = "(select *, case when i = 1 then 0.5 + n * 0.5 / all_n else 0.0 end score from (select *, row_number() over (partition by k order by n desc, v) i from (select k, v, count(distinct mid) n from wide group by k, v)) join (select k, count(distinct mid) all_n from wide group by k) using (k))"


def _greedy_sql(order: str) -> str:
    """One step per pick: the pairs so far cover their tables; counts are made anew."""
    steps = ["w0 as (select '' k, '' v where false)"]
    for i in range(1, PICKS + 1):
        steps.append(f"c{i} as (select distinct mid from wide where (k, v) in (select (k, v) from w{i - 1})), w{i} as (select * from w{i - 1} union all select k, v from (select k, v, count(distinct mid) filter (where mid in (select mid from c{i})) o, count(distinct mid) a from wide where (k, v) not in (select (k, v) from ex) and (k, v) not in (select (k, v) from w{i - 1}) group by k, v order by {order}, k, v limit 1))")
    return ", " + ", ".join(steps) + f" select k, v from w{PICKS}"


_select("x_max", f"select distinct k, v from wide where k in (select k from (select k, count(distinct mid) n from wide where k not in (select k from ex) group by k order by n desc, k limit {PICKS}))")
_select("xy_max", f"select k, v from {_N} order by n desc, k, v limit {PICKS}")
_select("xy_min", f"select k, v from {_N} order by n, k, v limit {PICKS}")
_select("xy_min_score", f"select k, v from {_MAJ} where (k, v) not in (select (k, v) from ex) order by round(score, 9), k, v limit {PICKS}")
_select("max_cover", _greedy_sql("a - o desc"))
_select("min_overlap", _greedy_sql("o, a"))
_select("oracle_bad", f"select k, v from {_N} where (k, v) not in (select (k, v) from rows0) order by n desc, k, v limit {PICKS}")
# written from the definition: the value list of a key grows while its sum less its pairwise gaps grows
_select("clustering", ", s as (select k, list(sc order by sc desc, v) ss, list(v order by sc desc, v) vs from (select k, v, round(1 - product(0.7), 12) sc from (select distinct k, v, mid from wide) group by k, v) group by k), g as (select k, ss, vs, m, list_sum(ss[1:m]) - coalesce(list_sum(list_transform(range(1, m + 1), lambda i: coalesce(list_sum(list_transform(range(i + 1, m + 1), lambda j: abs(ss[i] - ss[j]))), 0))), 0) f from s, unnest(range(1, len(ss) + 1)) t(m)), stop as (select k, min(m) m from (select *, f - coalesce(lag(f) over (partition by k order by m), 0) gain from g) where round(gain, 9) <= 0 group by k) select k, v from (select s.k, unnest(vs[stop.m + 1:]) v from s join stop using (k)) where (k, v) not in (select (k, v) from ex)")


# dependencies, keys, two hops, enrichment


@query("select 'c_nationkey' x, count(*) filter (where n > 1) n_classes, sum(n - 1)::bigint error from (select count(*) n from customer group by c_nationkey) union all select 'c_mktsegment,c_nationkey', count(*) filter (where n > 1), sum(n - 1)::bigint from (select count(*) n from customer group by c_mktsegment, c_nationkey)")
def stripped_partition(spark, d):
    return fd.partition_errors(table(spark, d, "customer"), [("c_nationkey",), ("c_mktsegment", "c_nationkey")])


def _g3_sql(t: str, x: tuple[str, ...], a: str) -> str:
    return f"select '{','.join(x)}' x, '{a}' a, sum(s - m)::bigint removed from (select sum(n) s, max(n) m from (select {', '.join(x)}, {a}, count(*) n from {t} group by all) group by {', '.join(x)})"


_G3 = [(("c_nationkey",), "c_mktsegment"), (("c_mktsegment", "c_nationkey"), "c_name"), (("c_custkey",), "c_name")]


@query(" union all ".join(_g3_sql("customer", x, a) for x, a in _G3))
def fd_g3(spark, d):
    return fd.g3(table(spark, d, "customer"), _G3)


_NC = ["n_nationkey", "n_name", "n_regionkey"]


@query(" union all ".join(f"select x, a from ({_g3_sql('nation', (x,), a)}) where removed = 0" for x in _NC for a in _NC if a != x))
def fds(spark, d):
    found = fd.dependencies(table(spark, d, "nation"), _NC, 0.0, 2)
    return spark.createDataFrame([(",".join(x), a) for x, a in found], "x string, a string")


_KC = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(" union all ".join(f"select '{c}' as \"key\" where (select count(distinct {c}) = count(*) from customer)" for c in _KC) + " union all select 'c_mktsegment,c_nationkey' where (select count(distinct (c_mktsegment, c_nationkey)) = count(*) from customer)")
def candidate_keys(spark, d):
    keys = fd.candidate_keys(table(spark, d, "customer"), _KC, 2)
    return spark.createDataFrame([(",".join(sorted(k)),) for k in keys], "key string")


_DEP = """, cn as (select tableid, colid, rowid, coalesce(tokenized, 'NULL') v from (select distinct tableid, colid, rowid, tokenized from cells)),
 per as (select tableid, colid, sum(n - 1) <= 0.1 * sum(n) is_key from (select tableid, colid, v, count(*) n from cn group by all) group by all),
 g as (select tableid, x_col, z_col, sum(s - m) removed, sum(s) total from (select tableid, x_col, z_col, x, sum(n) s, max(n) m from (select a.tableid, a.colid x_col, b.colid z_col, a.v x, b.v z, count(*) n from cn a join cn b on a.tableid = b.tableid and a.rowid = b.rowid and a.colid <> b.colid group by all) group by all) group by all),
 dep as (select g.tableid, x_col, z_col from g join per a on a.tableid = g.tableid and a.colid = x_col join per b on b.tableid = g.tableid and b.colid = z_col where a.is_key or (not b.is_key and removed <= 0.1 * total))
"""


def _deps(spark, d):
    return fd.cell_dependencies(table(spark, d, "main_tokenized"))


@query(_DEP + "select * from dep")
def fds_from_col(spark, d):
    return _deps(spark, d)


_STEM = "array_to_string(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x not in " + str(text.STOP_WORDS) + "), ' ')"
#: Two tables that share no key with the answer: suppliers with their nations, nations with their regions. Wanted: the region
#: of each supplier, given that of three.
_HOP = f""", hcells as (select 1::bigint tableid, 0 colid, s_suppkey rowid, {_STEM.format('s_name')} tokenized from supplier union all select 1, 1, s_suppkey, {_STEM.format('n_name')} from supplier join nation on s_nationkey = n_nationkey union all select 1, 2, s_suppkey, {_STEM.format('cast(round(s_acctbal) as int)::varchar')} from supplier
 union all select 2, 0, n_nationkey, {_STEM.format('n_name')} from nation union all select 2, 1, n_nationkey, {_STEM.format('r_name')} from nation join region on n_regionkey = r_regionkey),
 hu as (select distinct * from hcells where tokenized <> ''), hrows as (select s_suppkey rowid, {_STEM.format('s_name')} k, {_STEM.format('r_name')} v from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
 hex as (select k, v, 1.0::double score from (select * from hrows order by rowid limit 3)),"""
_DEPS = _DEP.lstrip(", ").replace("from cells)", "from hcells)")
_XZ = _HOP + " " + _DEPS.rstrip() + """, hx as (select tableid, colid from hu where tokenized in (select k from hrows) group by all having count(distinct tokenized) >= 2),
 xz0 as (select c.tableid, c.x_col, c.z_col, a.tokenized k, min(b.tokenized) z from dep c join hx on hx.tableid = c.tableid and hx.colid = c.x_col join hu a on a.tableid = c.tableid and a.colid = c.x_col join hu b on b.tableid = c.tableid and b.colid = c.z_col and b.rowid = a.rowid where a.tokenized in (select k from hrows) group by all),
 xz as (select * from xz0 where (tableid, x_col, z_col) in (select (tableid, x_col, z_col) from xz0 join hex using (k) group by tableid, x_col, z_col having count(distinct z) >= count(distinct v))) """


def _hop(spark, d):
    """(cells, rows, examples) of the two-hop case."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    sn = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda df, t, rowid, *cols: df.select(F.lit(t).cast("long").alias("tableid"), F.col(rowid).cast("int").alias("rowid"), F.posexplode(F.array(*cols)).alias("colid", "term"))
    c = one(sn, 1, "s_suppkey", "s_name", "n_name", F.round("s_acctbal").cast("int").cast("string")).unionByName(one(nr, 2, "n_nationkey", "n_name", "r_name")).withColumn("tokenized", text.stem(F.col("term")))
    rows = sn.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("rowid"), text.stem(F.col("s_name")).alias("k"), text.stem(F.col("r_name")).alias("v"))
    e = rows.orderBy("rowid").limit(GIVEN).select("k", "v", F.lit(1.0).alias("score"))
    return written(c, "hop"), rows, spark.createDataFrame(e.collect(), e.schema)


def _xz(spark, d):
    c, rows, e = _hop(spark, d)
    return c, rows, e, written(indirect.intermediate(c, rows, e, LEAST), "xz")


@query(_XZ + "select * from xz")
def intermediate(spark, d):
    return _xz(spark, d)[3]


_ZY = _XZ.rstrip() + """, zc as (select tableid, colid from hu where tokenized in (select z from xz) group by all having count(distinct tokenized) >= least(2, (select count(distinct v) from hex))),
 yc as (select tableid, colid from hu where tokenized in (select v from hex) group by all having count(distinct tokenized) >= least(2, (select count(distinct v) from hex))),
 zy as (select distinct concat(x.tableid, ':', x.colid, ':', y.colid) mid, a.tokenized k, b.tokenized v from zc x join yc y on x.tableid = y.tableid and x.colid <> y.colid join hu a on a.tableid = x.tableid and a.colid = x.colid join hu b on b.tableid = y.tableid and b.colid = y.colid and b.rowid = a.rowid),
 zu as (select mid, k z, count(distinct v) m, min(v) v from zy group by all),
 ez as (select distinct concat(tableid, ':', x_col, ':', z_col) x_mid, z, e.v y from xz join hex e on e.k = xz.k),
 jo as (select x_mid, mid, count(*) filter (where m = 1 and v = y) n from ez join zu using (z) group by all having count(*) filter (where m = 1 and v = y) >= least(2, (select count(distinct v) from hex)) and count(*) filter (where m > 1 or v <> y) = 0)
"""


@query(_ZY + "select x_mid, mid, n from jo")
def joinable_zy(spark, d):
    c, _, e, xz = _xz(spark, d)
    return indirect.joinable(xz, indirect.z_to_y(c, xz, e, LEAST), e, indirect.reachable(e, LEAST))


@query(_ZY + "select distinct concat(x_mid, '>', mid) mid, k, v from (select concat(tableid, ':', x_col, ':', z_col) x_mid, k, z from xz) join jo using (x_mid) join (select mid, z, v from zu) using (mid, z)")
def two_hop(spark, d):
    c, _, e, xz = _xz(spark, d)
    return indirect.hops(c, xz, e, LEAST)


@query(f"select distinct {_STEM.format('s_name')} k, {_STEM.format('r_name')} v from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey".replace("select", _HOP.rstrip(",") + " select", 1))
def transform_indirect(spark, d):
    """Direct search finds nothing here; every answer comes over the two hops."""
    c, rows, e = _hop(spark, d)
    half = lambda a: a.select("mid").distinct().select("mid", F.lit(0.5).alias("prior"), F.lit(0.5).alias("schema"))
    return indirect.transform(c, rows, e, half, LEAST).select("k", "v")


_RICH = _DEPS.replace("from hcells)", "from cells where tableid in (select tableid from xt))").rstrip()


@query(", xt as (select tableid, min(colid) c0 from (select tableid, colid from uc where tokenized in (select k from rows0) group by all having count(distinct tokenized) >= 10) group by tableid order by tableid limit 20), xc as (select tableid, colid from uc where tableid in (select tableid from xt) and tokenized in (select k from rows0) group by all having count(distinct tokenized) >= 10), " + _RICH + " select a.tokenized k, concat('t_', d.tableid, '_', d.z_col) name, min(b.tokenized) z from dep d join xc on xc.tableid = d.tableid and xc.colid = d.x_col join uc a on a.tableid = d.tableid and a.colid = d.x_col join uc b on b.tableid = d.tableid and b.colid = d.z_col and b.rowid = a.rowid where a.tokenized in (select k from rows0) group by all")
def enrich(spark, d):
    """What the first 20 tables with ten of the keys add to each key, by the columns that the key determines."""
    return indirect.enrichment(rest(spark, d), rows0(spark, d), 10, 20)


@query("select n_name k, min(s_name) t1_1, min(c_name) t2_1 from nation left join supplier on s_nationkey = n_nationkey left join customer on c_nationkey = n_nationkey group by n_name")
def enrich_wide(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("k"))
    one = lambda t, key, z, i: n.join(table(spark, d, t), F.col("n_nationkey") == F.col(key)).select(F.lit(i).alias("tableid"), F.lit(1).alias("z_col"), "k", F.col(z).alias("z"))
    xz = one("supplier", "s_nationkey", "s_name", 1).unionByName(one("customer", "c_nationkey", "c_name", 2))
    return indirect.widen(n, xz, ["t_1_1", "t_2_1"]).withColumnsRenamed({"t_1_1": "t1_1", "t_2_1": "t2_1"})


@query("select k, v, count(*) n from (select k, v from rows0 union all select k, v from mapped where k in (select k from rows0)) group by k, v")
def alternatives(spark, d):
    """The original values and what matched tables say of the same keys."""
    return indirect.alternatives(rows0(spark, d), mapped(spark, d).select("k", F.col("v").alias("z")))


@query("select own_col, rowid, o.v, w.v other, count(*) n from (select rowid, 1 own_col, v, k from rows0) o join (select distinct x.tableid, x.rowid r, x.tokenized k, y.colid, y.tokenized v from uc x join uc y on x.tableid = y.tableid and x.rowid = y.rowid and x.colid <> y.colid join matches m on m.tableid = x.tableid and m.x_col = x.colid and m.y_col = y.colid) w using (k) where o.v <> w.v group by all")
def clean(spark, d):
    """Other values that matched tables give where a row shares its key with them."""
    m = written(matches(spark, d), "matches")
    web = score.row_values(rest(spark, d), m)
    return indirect.marked(rows0(spark, d), web)


# column matching, graph, look-ups, strings, pages, evaluation

_COV = "(select own_col, web_col, sum(n)::bigint n from (select concat(tableid, ':', colid) web_col, tokenized v, count(*) n from cells where tokenized is not null and tableid <> (select id from t0) group by all) join (select distinct 0 own_col, k v from rows0 union select distinct 1, v from rows0) using (v) group by all)"


def _cov(spark, d):
    """Of every column of the corpus, the rows whose value the input's keys (0) or values (1) hold."""
    r = rows0(spark, d)
    own = r.select(F.lit(0).alias("own_col"), F.col("k").alias("v")).union(r.select(F.lit(1), "v"))
    web = rest(spark, d).where("tokenized is not null").select("tableid", "colid", "rowid", "term", "tokenized").distinct().select(F.concat_ws(":", "tableid", "colid").alias("web_col"), F.col("tokenized").alias("v"))
    return match.coverage(web, own)


@query(f"select * from {_COV}")
def coverage(spark, d):
    return _cov(spark, d)


@query(f"select own_col, web_col, n from (select *, row_number() over (partition by own_col order by n desc, web_col) i from {_COV}) where i = 1 and n >= 2")
def map_column(spark, d):
    return match.best_column(_cov(spark, d), LEAST)


@query(f", cov as (select * from {_COV} where split_part(web_col, ':', 1)::bigint in (select tableid from matches)), two as (select a.web_col w0, a.n n0, b.web_col w1, b.n n1 from (select web_col, n from cov where own_col = 0) a, (select web_col, n from cov where own_col = 1) b where a.web_col <> b.web_col order by n0 + n1 desc limit 1) select 0 own_col, w0 web_col, n0 n from two union all select 1, w1, n1 from two")
def col_map(spark, d):
    ids = [str(r[0]) for r in matches(spark, d).select("tableid").distinct().limit(1000).collect()]
    return match.column_mapping(_cov(spark, d).where(F.split("web_col", ":")[0].isin(ids)), 0)


@query("select distinct c_mktsegment v, concat('s', s_suppkey) subject from customer join supplier on s_suppkey = c_nationkey where false union all select lower(n_name), concat('n', n_nationkey) from nation")
def entity_match(spark, d):
    t = load_triples(spark, d)
    return match.entity_match(table(spark, d, "nation").select(F.lower("n_name").alias("v")), t)


_FIELDS = """(select 'header' field, header_tokenized tok, tableid from columns_tokenized union all select 'content', tokenized, tableid from main_tokenized union all select f, unnest(string_split(t, ' ')), id from (select id, 'title' f, title_tokenized t from new_tables_tokenized_full union all select id, 'context', context_tokenized from new_tables_tokenized_full))"""
_POST = "(select field, tok, tableid from (select *, row_number() over (partition by field, tok order by tableid) i, count(*) over (partition by field, tok) c from (select distinct field, tok, tableid from {0} where tok <> '' {1})) where c > 1 and i <= 1000)"


_HPOST = _POST.format(_FIELDS, "and field = 'header'")


def _terms(spark, d):
    """(field, tok, tableid) of content, context, header and title."""
    m = table(spark, d, "main_tokenized").select(F.lit("content").alias("field"), F.col("tokenized").alias("tok"), "tableid")
    h = table(spark, d, "columns_tokenized").select(F.lit("header").alias("field"), F.col("header_tokenized").alias("tok"), "tableid")
    t = table(spark, d, "new_tables_tokenized_full")
    of = lambda f: t.select(F.lit(f).alias("field"), F.explode(F.split(f"{f}_tokenized", " ")).alias("tok"), F.col("id").alias("tableid"))
    return h.unionByName(m).unionByName(of("title")).unionByName(of("context"))


@query(f"select * from {_POST.format(_FIELDS, '')}")
def postings(spark, d):
    return graph.postings(_terms(spark, d))


@query(f", s as (select * from {_HPOST}) select distinct x.tableid a, y.tableid b from s x join s y using (field, tok) where x.tableid < y.tableid")
def join_graph(spark, d):
    return graph.join_graph(graph.postings(_terms(spark, d).where("field = 'header'")))


@query(f", s as (select tableid, list(tok order by tok) ts from (select distinct tok, tableid from {_HPOST}) group by tableid), k as (select ts, min(tableid) c from s group by ts), l as (select distinct a.c x, b.c y from (select c, unnest(ts) t from k) a join (select c, unnest(ts) t from k) b on a.t = b.t and a.c < b.c), n as (select c, count(*) n from (select x c from l union all select y from l) group by c) select s.tableid, k.c \"class\", coalesce(n, 0) n_links from s join k using (ts) left join n on n.c = k.c")
def join_classes(spark, d):
    return graph.join_classes(graph.postings(_terms(spark, d).where("field = 'header'")))


@query("select distinct tableid, colid from cells where term in (select term from cells where tableid = (select id from t0) and colid = 0)")
def find_data_keys(spark, d):
    own = table(spark, d, "main_tokenized").where((F.col("tableid") == _t0(spark, d)) & (F.col("colid") == 0)).select("term").where("term is not null")
    return lookup.find_data_keys(table(spark, d, "main_tokenized"), own)


@query("select n_name || ' x' input, arg_min(term, (-length(term), term)) term, 0 kind from nation join (select n_name term from nation union select r_name from region) t on contains(n_name || ' x', term) or contains(term, n_name || ' x') group by n_name")
def all_data_keys(spark, d):
    n = table(spark, d, "nation")
    c = n.select(F.col("n_name").alias("term")).union(table(spark, d, "region").select("r_name"))
    return lookup.all_data_keys(c, n.select(F.concat("n_name", F.lit(" x")).alias("input")))


def _nation_cells(spark, d):
    n = table(spark, d, "nation").select(F.lit(1).alias("tableid"), F.col("n_nationkey").alias("rowid"), F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).alias("colid", "term"))
    r = table(spark, d, "region").select(F.lit(2).alias("tableid"), F.col("r_regionkey").alias("rowid"), F.posexplode(F.array(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), "r_name")).alias("colid", "term"))
    return n.unionByName(r)


@query("select n_nationkey rowid, n_name term from nation where n_regionkey = 1 and n_nationkey in (1, 2, 3)")
def lookup_query(spark, d):
    return lookup.lookup(_nation_cells(spark, d), {2: ["r1"], 0: ["1", "2", "3"]}, 1, 1)


@query("select n_name input, 1 tableid, i colid, case i when 0 then cast(n_nationkey as varchar) when 1 then n_name else concat('r', n_regionkey) end term from nation, range(3) t(i)")
def find_all(spark, d):
    return lookup.find_all(_nation_cells(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("input")))


@query("select n_name input, r_name value from nation join region on n_regionkey = r_regionkey")
def lookup_chain(spark, d):
    return lookup.chain(_nation_cells(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("input")), [(1, 1, 2), (2, 0, 1)])


@query("select concat('1:', i, ':', j) path, n_nationkey id, case j when 0 then n_nationkey::varchar when 1 then n_name else concat('r', n_regionkey) end \"value\" from nation, (values (1, 0), (1, 2)) t(i, j) where n_nationkey < 3 union all select concat('1:1:2>2:0:', 1), n_nationkey, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey < 3")
def lookup_chains(spark, d):
    """All chains of up to two tables from three nations."""
    e = table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("int").alias("id"), F.array("n_name").alias("parts"), F.lit("").alias("y"))
    return lookup.generate(_nation_cells(spark, d), e)


@query("select n_nationkey id, concat(upper(r_name[1]), lower(r_name[2:]), ' / ', n_name) output from nation join region on n_regionkey = r_regionkey")
def lookup_program(spark, d):
    """A program of a two-table chain and a string program, learned from two examples and run on all nations."""
    c = _nation_cells(spark, d)
    two = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey in (0, 2)").orderBy("n_nationkey").collect()
    p = lookup.learn(c, [([r["n_name"]], f"{r['r_name'].capitalize()} / {r['n_name']}") for r in two])
    return lookup.apply(p, c, table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array("n_name").alias("parts")))


@query("select tableid, count(distinct colid) n_columns from cells group by tableid")
def catalog_keys(spark, d):
    return lookup.catalog_keys(table(spark, d, "main_tokenized")).groupBy("tableid").agg(F.count("*").alias("n_columns"))


@query("select c_nationkey g, arg_max(c_name || repeat('x', (c_custkey % 3)::int), (length(c_name || repeat('x', (c_custkey % 3)::int)), -c_custkey)) s from customer group by 1")
def longest(spark, d):
    return lookup.longest(table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("i"), F.expr("c_name || repeat('x', int(c_custkey % 3))").alias("s")))


@query("select x, y from (values ('Mr', 'Steve'), ('Russell', 'Russell2'), ('John', 'John2'), ('Henry', 'Henry2')) t(x, y) where false union all select 'Land', 'Stadt' where false union all select c, o from (values ('Algeria', 'Algiers'), ('Angola', 'Luanda')) t(c, o)")
def split_examples(spark, d):
    p = spark.createDataFrame([(1, "Land: Algeria", "City: Algiers"), (2, "Land: Angola", "City: Luanda")], "i int, x string, y string")
    return lookup.split_examples(p)


@query("select c_custkey, concat('C-', c_custkey) y from customer")
def string_program(spark, d):
    parts = strings.learn([(["Customer#000000012"], "C-12"), (["Customer#000000907"], "C-907")])
    c = table(spark, d, "customer")
    return c.select("c_custkey", strings.compile_program(parts, [F.col("c_name")]).alias("y"))


@query("select o_orderkey, strftime(o_orderdate, '%d.%m.%Y') y from orders")
def apply_program(spark, d):
    parts = strings.learn([(["1995-03-07"], "07.03.1995"), (["1996-11-25"], "25.11.1996"), (["1992-01-02"], "02.01.1992")])
    o = table(spark, d, "orders")
    return o.select("o_orderkey", strings.compile_program(parts, [F.date_format("o_orderdate", "yyyy-MM-dd")]).alias("y"))


def _pages(spark, d):
    u = table(spark, d, "new_tables_tokenized_full").select(F.col("id").alias("page_id"), "title", "domain").distinct()
    html = F.concat(F.lit("<html><body><form method='get'><input type='text' name='q'><select name='s'></select></form><p>"), F.coalesce(F.regexp_replace("title", "[<>&]", " "), F.lit("")), F.lit("</p></body></html>"))
    return u.groupBy("page_id").agg(F.min("title").alias("title")).select("page_id", "title", html.alias("html"))


@query("select distinct id page_id, 0 form, 'get' \"method\", name, kind from new_tables_tokenized_full, (values ('q', 'text'), ('s', 'select')) t(name, kind)")
def web_forms(spark, d):
    return forms.forms(_pages(spark, d))


@query("select 1 g, '/html/body/p' path, count(distinct id) n from (select id, min(title) t from new_tables_tokenized_full group by id) where regexp_full_match(t, '[ -~]*\\S[ -~]*') and not regexp_matches(t, '\\s\\s|^\\s|\\s$|[<>&]') having count(*) >= 2")
def induce_path(spark, d):
    p = _pages(spark, d).where(F.col("title").rlike(r"^[ -~]*\S[ -~]*$") & ~F.col("title").rlike(r"\s\s|^\s|\s$|[<>&]"))
    r = forms.texts(p).join(p.select("page_id", F.col("title").alias("y")), "page_id").select(F.lit(1).alias("g"), F.col("page_id").alias("x"), "y", "path", "text")
    return forms.induce_path(r)


@query("select distinct id, url is not null and not regexp_matches(lower(url), '\\.(" + "|".join(forms.SKIPPED) + ")$') wanted from new_tables_tokenized_full")
def url_filter(spark, d):
    return table(spark, d, "new_tables_tokenized_full").select("id", forms.wanted_url(F.col("url")).alias("wanted")).distinct()


@query("select c_name k, 2 n_examples from customer")
def crowd_questions(spark, d):
    """The keys of all questions, each of which shows the two examples."""
    e = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    q = evaluate.question_batches(table(spark, d, "customer").select(F.col("c_name").alias("k")), 10, examples=e)
    j = F.from_json("question", "keys array<string>, examples array<struct<k string, v string>>")
    return q.select(j.alias("j")).select(F.explode("j.keys").alias("k"), F.size("j.examples").alias("n_examples"))


_PR = f"(select count(*) filter (where b.v = t.v) c, count(b.v) a, count(*) t from (select k, min(v) v from rows0 group by k) t left join {_FINAL} b using (k))"


@query(f"select greatest(c - 3, 0) correct, greatest(a - 3, 0) answered, t - 3 total, round(coalesce(greatest(c - 3, 0) / nullif(greatest(a - 3, 0), 0), 0), 6) \"precision\", round(coalesce(greatest(c - 3, 0) / nullif(t - 3, 0), 0), 6) recall from {_PR}")
def precision_recall(spark, d):
    """Of the flagship; the given examples don't count."""
    truth = rows0(spark, d).groupBy("k").agg(F.min("v").alias("v"))
    return _rounded(evaluate.precision_recall(induced(spark, d, SEARCHES).examples, truth, GIVEN), "precision", "recall")


@query(f"select greatest(c - 3, 0) correct, greatest(a - 3, 0) answered, t total, round(coalesce(greatest(c - 3, 0) / nullif(greatest(a - 3, 0), 0), 0), 6) \"precision\", round(coalesce(greatest(c - 3, 0) / nullif(t, 0), 0), 6) recall from (select count(*) c, count(*) a, count(*) t from hrows)".replace("select", _HOP.rstrip(",") + " select", 1))
def precision_recall_indirect(spark, d):
    """Of the two-hop transformation; its total keeps the given examples."""
    c, rows, e = _hop(spark, d)
    half = lambda a: a.select("mid").distinct().select("mid", F.lit(0.5).alias("prior"), F.lit(0.5).alias("schema"))
    found = indirect.transform(c, rows, e, half, LEAST)
    return _rounded(evaluate.precision_recall(found, rows.select("k", "v"), GIVEN, indirect=True), "precision", "recall")


@query("select c correct, a answered, t total, round(c / a, 6) \"precision\", round(c / t, 6) recall from (select count(*) c, count(*) a, (select count(*) from supplier) t from supplier where s_suppkey % 7 <> 0)")
def precision_recall_lookup(spark, d):
    """Of look-ups: equality but for case, and no output is no answer."""
    s = table(spark, d, "supplier")
    found = s.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.upper("s_name")).alias("v"))
    return _rounded(evaluate.precision_recall(found, s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ignore_case=True, blank_is_none=True), "precision", "recall")


@query("select tableid, count(distinct rowid) n_rows from cells group by tableid having count(distinct colid) = (select min(c) from (select count(distinct colid) c from cells group by tableid))")
def smallest_tables(spark, d):
    return evaluate.smallest_tables(cells(spark, d))


@query("select n_nationkey, [n_nationkey, n_regionkey] keys from nation")
def keys_from_names(spark, d):
    name = F.concat(F.lit("(77, ["), "n_nationkey", F.lit("], ["), "n_regionkey", F.lit("], 0).csv"))
    return table(spark, d, "nation").select("n_nationkey", evaluate.keys_from_name(name).alias("keys"))


@query("select n_name, levenshtein(n_name, 'INDIA') dist, round(1 - levenshtein(n_name, 'INDIA') / greatest(length(n_name), 5), 6) sim, round(1 - levenshtein(lower(n_name), 'india') / greatest(length(n_name), 5), 6) esim, upper(n_name[1]) in ('A', 'E', 'I', 'O', 'U') vowel, trim(regexp_replace(regexp_replace(n_name || ' (x|y)', '[^A-Za-z0-9 |]', ' ', 'g'), ' +', ' ', 'g')) polished, 'my Camel Case' || ' 12' camel, n_nationkey % 2 = 0 blank, case when n_regionkey >= n_nationkey then 0 else 1 end::bigint top, abs(levenshtein(n_name, 'INDIA')) <= 3 alike, n_nationkey % 3 = 0 no_value from nation")
def scalar_functions(spark, d):
    n = F.col("n_name")
    same = text.similar_components(F.array(n, F.lit("x"), F.lit(None)), F.array(F.lit("INDIA"), F.lit("x"), F.lit(None)))
    gone = text.all_null(F.array(F.when(F.col("n_nationkey") % 3 != 0, n), F.lit(None).cast("string")))
    return table(spark, d, "nation").select(n, F.levenshtein(n, F.lit("INDIA")).alias("dist"), F.round(text.similarity(n, F.lit("INDIA")), 6).alias("sim"), F.round(text.edit_similarity(n, F.lit("india")), 6).alias("esim"), text.is_vowel(F.substring(n, 1, 1)).alias("vowel"), text.polish(F.concat(n, F.lit(" (x|y)"))).alias("polished"), text.split_camel_case(F.lit("myCamelCase12")).alias("camel"), text.is_empty(F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise(n)).alias("blank"), text.index_of_max(F.array("n_regionkey", "n_nationkey")).alias("top"), same.alias("alike"), gone.alias("no_value"))


@query("select n_nationkey rowid, case when n_nationkey = 3 then 'set' else n_name end term from nation")
def set_cell(spark, d):
    c = _nation_cells(spark, d).where("tableid = 1")
    return corpus.set_cell(c, 1, 3, 1, "set").where("colid = 1").select("rowid", "term")


@query("select concat('w', n_nationkey) wrapper, 2 + (n_regionkey = 1)::int n from nation order by n desc, wrapper limit 10")
def wrapper_index(spark, d):
    w = table(spark, d, "nation").select(F.concat(F.lit("w"), "n_nationkey").alias("wrapper"), F.concat(F.lit("region r"), "n_regionkey").alias("content"), F.lit("Country name").alias("input_name"), F.lit("x").alias("output_name"))
    path = scratch(spark, "wrappers")
    forms.write_index(w, path)
    return forms.search_index(spark.read.parquet(path), "r1", "country name", "y").select("wrapper", F.col("n").cast("int").alias("n"))


@query("select concat('f', n_regionkey) file, max(n_nationkey)::int not_found, max(n_nationkey) / 25 \"precision\", max(n_nationkey) / 50 recall, max(n_nationkey) * 1.5 runtime_s from nation group by n_regionkey")
def collate_results(spark, d):
    n = F.col("n_nationkey")
    return evaluate.collate(table(spark, d, "nation").select(F.concat(F.lit("f"), "n_regionkey").alias("file"), n.cast("int").alias("not_found"), (n / 25).alias("precision"), (n / 50).alias("recall"), (n * 1500).alias("runtime_ms")))


@query("select x, a from (values ('n_nationkey', 'n_name'), ('n_name', 'n_nationkey'), ('n_nationkey', 'n_regionkey')) t(x, a) where (select count(distinct n_name) = count(*) from nation) union all select x, a from (values ('n_name', 'n_nationkey')) t(x, a) where false")
def minimal_cover(spark, d):
    """A cover of nation's dependencies: key and name imply each other, so that one of them need not imply the region."""
    found = fd.dependencies(table(spark, d, "nation"), _NC, 0.0, 2)
    cover = fd.minimal_cover(found)
    assert all(a in fd.closure(set(x), cover) for x, a in found)
    name = {frozenset(("n_name",)): "n_name", frozenset(("n_nationkey",)): "n_nationkey"}
    # either of the two may carry the region: named by the key
    rows = [("n_nationkey" if a == "n_regionkey" else name[frozenset(x)], a) for x, a in cover]
    return spark.createDataFrame(rows, "x string, a string")


@query("select n_columns, n_keys from (select 3 n_columns, (select count(distinct n_name) = count(*) from nation)::int + 1 n_keys) union all select 12, 12")
def keys_of_source(spark, d):
    n = table(spark, d, "nation")
    broad = n.select(*(F.col("n_name").alias(f"c{i}") for i in range(12)))
    return spark.createDataFrame([(len(t.columns), len(fd.keys_of_source(t))) for t in (n, broad)], "n_columns int, n_keys int")


@query("select 'tables' what, count(distinct tableid) n from cells union all select 'keys', count(*) from (select distinct tableid, colid from cells) union all select 'found', count(*) from (select distinct tableid, colid from cells where term in ('yes', 'Yes', 'unknown')) union all select 'rows', count(*) from (select tableid from cells where term in ('yes', 'Yes', 'unknown') group by tableid, term)")
def lookup_source(spark, d):
    """The source over the corpus' cells, through its interface."""
    s = lookup_source_module.CellSource(cells(spark, d), table(spark, d, "columns_tokenized"))
    asked = ["yes", "Yes", "unknown"]
    counts = [("tables", s.tables().count()), ("keys", s.find_candidate_keys().count()), ("found", s.find_data_keys(asked).count()), ("rows", s.find_all(asked).select("tableid", "input").distinct().count())]
    return spark.createDataFrame(counts, "what string, n long")
