"""Queries of the training-data problems, and their SQL where SQL can state the problem."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import capping, distinctive, encoding, leakage, mojibake, set_join, term_counts, truncation
from tabweave.operators.search import small
from tabweave.plans.common import scratch, table, written


def _column_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "main_tokenized").select(F.struct("tableid", "colid").alias("r"), F.col("tokenized").alias("v"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = set_join.pairs(_column_sets(spark, d), 0.6, 8)
    return found.select(F.col("a.tableid").alias("tableid_a"), F.col("a.colid").alias("colid_a"), F.col("b.tableid").alias("tableid_b"), F.col("b.colid").alias("colid_b"))


def p2_membership(spark: SparkSession, d: str) -> DataFrame:
    """Each column with its class of equal columns and the classes linked to that."""
    found = set_join.membership(_column_sets(spark, d), 0.6, 8)
    return found.select("r.tableid", "r.colid", F.col("class.tableid").alias("class_tableid"), F.col("class.colid").alias("class_colid"), "n_links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.dropped(table(spark, d, "new_tables_tokenized_full"), share=0.02)


def p4_kept_per_contributor(spark: SparkSession, d: str) -> DataFrame:
    r = capping.ranked(table(spark, d, "new_tables_tokenized_full"), share=0.02)
    return r.groupBy("contributor").agg(F.count_if(~F.col("over")).alias("n_kept"), F.count_if("over").alias("n_dropped"))


#: Tables loaded in the last days of the corpus are a delta to the counts of all tables loaded before.
LATE_DAYS = 90


def _counted(spark: SparkSession, d: str) -> term_counts.TermCounts:
    """The corpus as it was LATE_DAYS before its last load, and then, on the state opened again, what came since."""
    root = scratch(spark, "terms")
    cells = table(spark, d, "main_tokenized").select("tableid", "colid", "rowid", "term", "tokenized")
    loads = table(spark, d, "new_tables_tokenized_full").select(F.col("id").alias("tableid"), "loaded_at")
    last = loads.agg(F.max("loaded_at").alias("last"))  # one row
    late = small(loads.join(F.broadcast(last), F.col("loaded_at") > F.col("last") - F.expr(f"interval {LATE_DAYS} days")).select("tableid").distinct())
    term_counts.TermCounts(spark, root).apply(added=cells.join(late, "tableid", "left_anti"))
    state = term_counts.TermCounts(spark, root)
    state.apply(added=cells.join(late, "tableid", "left_semi"))
    return state


def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Three deltas, the state opened again for each: the tables of sources up to 4; those of the other sources; those of
    source 1 go, and those of source 2 lose their first column."""
    root = scratch(spark, "terms")
    of = table(spark, d, "new_tables_tokenized_full").groupBy(F.col("id").alias("tableid")).agg(F.coalesce(F.min("source"), F.lit(0)).alias("source"))
    cells = table(spark, d, "main_tokenized").select("tableid", "colid", "rowid", "term", "tokenized").join(of, "tableid", "left").withColumn("source", F.coalesce("source", F.lit(0)))
    plain = lambda where: cells.where(where).drop("source")
    term_counts.TermCounts(spark, root).apply(added=plain("source <= 4"))
    term_counts.TermCounts(spark, root).apply(added=plain("source > 4"))
    state = term_counts.TermCounts(spark, root)
    state.apply(added=plain("source = 2 and colid <> 0"), removed=plain("source in (1, 2)"))
    return term_counts.TermCounts(spark, root).terms()


def _n_tables(spark: SparkSession, d: str) -> int:
    return table(spark, d, "main_tokenized").select("tableid").distinct().count()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marks(_counted(spark, d).terms(), _n_tables(spark, d), table(spark, d, "inverse_document_frequency"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).terms().where("field = 'term'").select(F.col("value").alias("term"), "occurrences", "records")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    weights = written(distinctive.frequencies(table(spark, d, "main_tokenized")), "frequencies")
    return distinctive.best(distinctive.scores(weights, _n_tables(spark, d))).select("tableid", "tokenized")


def p6_graph_of_words(spark: SparkSession, d: str) -> DataFrame:
    weights = written(distinctive.degrees(table(spark, d, "main_tokenized")), "degrees")
    return distinctive.best(distinctive.scores(weights, _n_tables(spark, d)), 10).select("tableid", "tokenized", "weight", "score")


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "new_tables_tokenized_full"), table(spark, d, "main_tokenized"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).select("field", "tableid", "colid", "rowid")


def p7_branches(spark: SparkSession, d: str) -> DataFrame:
    """How many cases of each field were found at a limit, by their ending alone, or by the stored content."""
    return _truncated(spark, d).groupBy("field", "by").agg(F.count("*").alias("n"))


def p7_share_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Values of each field and source, and how many of them are cut."""
    t = table(spark, d, "new_tables_tokenized_full").select("id", "source", "title", "context").distinct()
    n = t.groupBy("source").agg(F.count("title").alias("title"), F.count("context").alias("context"))
    per = table(spark, d, "main_tokenized").where("term is not null").select("tableid", "colid", "rowid").distinct().groupBy("tableid").agg(F.count("*").alias("n"))
    terms = per.join(t.select(F.col("id").alias("tableid"), "source").distinct(), "tableid").groupBy("source").agg(F.sum("n").alias("term"))
    values = n.join(terms, "source", "left").unpivot("source", ["title", "context", "term"], "field", "n_values")
    cut = _truncated(spark, d).groupBy("field", "source").agg(F.count("*").alias("n_cut"))
    out = values.join(cut, ["field", "source"], "left").withColumn("n_cut", F.coalesce("n_cut", F.lit(0)))
    return out.withColumn("share", F.round(F.try_divide("n_cut", "n_values"), 6))


def _vocabulary() -> str:
    return os.environ.get("TABWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), _vocabulary())


def p8_token_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and the longest document of each language as given."""
    ids = encoding.encode(table(spark, d, "documents"), _vocabulary()).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    n = F.size("ids").cast("long")
    return ids.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.max(n).alias("most_tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_locations(spark: SparkSession, d: str) -> DataFrame:
    """Each leak with its longest run and its longest verbatim match, and where that begins in document and item."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each source once the documents that leak an item are removed."""
    docs = table(spark, d, "documents")
    left = leakage.clean(docs.select("doc_id", "source"), leakage.leaks(docs, table(spark, d, "eval_items")))
    return left.groupBy("source").agg(F.count("*").alias("n_docs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.cases(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_membership, p4_found, p4_kept_per_contributor, p5_found, p5_counts, p5_incremental, p6_found, p6_graph_of_words, p7_found, p7_branches, p7_share_per_source, p8_ids, p8_token_totals, p9_found, p9_locations, p9_clean_corpus, p10_found, p10_restored)}

_CONTRIBUTOR = r"""select distinct id, regexp_replace(regexp_replace(lower(trim(case when trim(coalesce(domain, '')) <> '' then domain
 else regexp_extract(coalesce(url, ''), '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) end)), '\.+$', ''), '^www\.', '') c,
 greatest(coalesce(openrank, 0), 0) o, coalesce(confidence, 0) q from new_tables_tokenized_full"""
_RANKED = f"select id, c, row_number() over (partition by c order by o desc, q desc, id) > ceil(0.02 * (select count(distinct id) from new_tables_tokenized_full)) over_cap from ({_CONTRIBUTOR})"
_CELLS = "(select distinct tableid, colid, rowid, term, tokenized from main_tokenized)"

_SETS = "(select tableid, colid, list(distinct tokenized) s from main_tokenized where tokenized <> '' group by all having count(distinct tokenized) >= 8)"

_MEMBER = f"""with s as (select tableid, colid, list_sort(list(distinct tokenized)) s from main_tokenized where tokenized <> '' group by all having count(distinct tokenized) >= 8),
 k as (select s, min((tableid, colid)) c, len(s) n from s group by s),
 l as (select a.c x, b.c y from k a join k b on a.c < b.c and b.n >= 0.6 * a.n and a.n >= 0.6 * b.n where len(list_intersect(a.s, b.s)) >= 0.6 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
 n as (select c, count(*) n_links from (select x c from l union all select y from l) group by c)
 select s.tableid, s.colid, k.c[1] class_tableid, k.c[2] class_colid, coalesce(n_links, 0) n_links from s join k on k.s = s.s left join n on n.c = k.c"""

SQL = {
    "p2_membership": _MEMBER,
    "p2_found": f"""with s as {_SETS} select a.tableid tableid_a, a.colid colid_a, b.tableid tableid_b, b.colid colid_b from s a join s b on (a.tableid, a.colid) < (b.tableid, b.colid)
 and len(b.s) >= 0.6 * len(a.s) and len(a.s) >= 0.6 * len(b.s) where len(list_intersect(a.s, b.s)) >= 0.6 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))""",
    "p4_found": f"select id from ({_RANKED}) where over_cap",
    "p4_kept_per_contributor": f"select c contributor, count(*) filter (not over_cap) n_kept, count(*) filter (over_cap) n_dropped from ({_RANKED}) group by c",
    "p5_found": f"""select term, 'rare' mark from {_CELLS} where term is not null group by term having count(*) = 1
 union all select term, 'common' from {_CELLS} where term is not null group by term having count(distinct tableid) > 0.03 * (select count(distinct tableid) from main_tokenized)
 union all select distinct i.term, 'drift' from inverse_document_frequency i left join (select tokenized, count(distinct tableid) n from main_tokenized group by 1) m on m.tokenized = i.term where number_occurence is not null and number_occurence <> coalesce(n, 0)""",
    "p5_counts": f"select term, count(*) occurrences, count(distinct tableid) records from {_CELLS} where term is not null group by term",
    "p5_incremental": f"""with c as (select m.*, coalesce(s, 0) source from {_CELLS} m left join (select id, min(source) s from new_tables_tokenized_full group by id) t on t.id = m.tableid),
 k as (select * from c where source <> 1 and not (source = 2 and colid = 0)), v as (select 'term' field, term "value", tableid from k union all select 'tokenized', tokenized, tableid from k)
 select field, "value", count(*) occurrences, count(distinct tableid) records from v where "value" is not null group by all""",
    "p6_found": f"""select tableid, tokenized from (select tableid, tokenized, row_number() over (partition by tableid order by round(n * ln((select count(distinct tableid) from main_tokenized) / df), 6) desc, tokenized) k
 from (select tableid, tokenized, count(*) n from {_CELLS} where tokenized <> '' group by all) join (select tokenized, count(distinct tableid) df from main_tokenized group by 1) using (tokenized)) where k <= 3""",
    "p6_graph_of_words": f"""with c as (select tableid, colid, tokenized, row_number() over (partition by tableid, colid order by rowid, tokenized) i from {_CELLS} where tokenized <> ''),
 e as (select a.tableid, a.tokenized, b.tokenized o from c a join c b on a.tableid = b.tableid and a.colid = b.colid and abs(a.i - b.i) between 1 and 3 and a.tokenized <> b.tokenized),
 w as (select p.tableid, p.tokenized, coalesce(n, 0) weight from (select distinct tableid, tokenized from c) p left join (select tableid, tokenized, count(distinct o) n from e group by all) using (tableid, tokenized)),
 s as (select tableid, w.tokenized, weight, round(weight * ln((select count(distinct tableid) from main_tokenized) / df), 6) score from w join (select tokenized, count(*) df from w group by 1) d on d.tokenized = w.tokenized)
 select tableid, tokenized, weight, score from (select *, row_number() over (partition by tableid order by score desc, tokenized) k from s) where k <= 10""",
}
