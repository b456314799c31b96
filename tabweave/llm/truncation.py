"""Text values whose end was cut off, by a field limit or in mid-transfer.

1. Length hazards. Per field, source and unit (characters, bytes), the hazard of a length is the share of the values at
   least that long that end there; window functions give the values at risk and the pooled hazard of the neighbouring
   lengths. A length is a limit if its count is too large for the neighbours' hazard (Poisson bound) with the false
   discovery rate held at FDR over all lengths of all fields (Benjamini-Hochberg).
   Cells have lengths that their format fixes; a limit of cells must also end most of the cells that reach it.
2. Incomplete endings. A value at a limit is cut unless its ending is complete; a value elsewhere is cut only if its
   ending is plainly not one.
   - Running text is complete if it ends a sentence. A list of words at a limit is cut; elsewhere it is cut if it ends
     in a word that stands nowhere inside a value, or in a blank.
   - A title is complete if its pattern is one that titles away from the limits have (frequent words kept, others
     blanked, figures by their number of digits) and its last word is one that titles end in. A pattern that is the
     beginning of one at least five times as frequent is no pattern of complete titles. A page title that goes
     on where the title stops shows the cut; one that goes on with a separator and a site name shows completeness.
     A last word that stands nowhere inside a title and is the beginning of a word at least five times as frequent as
     that ending (in at least LONGER of the titles) is broken off, whatever the pattern.
   - A cell at a limit is cut. Elsewhere it is if the same cell in the table's stored content goes on, or if it ends in a
     broken word: one that stands nowhere inside a cell, that ends different cells rather than equal ones, and that begins
     a word at least BROKEN times as frequent.
   An ellipsis is taken off first; what remains is judged in the same way, so that an ellipsis behind a complete title
   is no case.

Each case names the branch that found it (by): limit, a significant length; ending, an incomplete ending elsewhere;
continued, the stored content goes on.

Word and pattern statistics cover all values. What is sent has a bound: the frequent words (at most the mean number of
words / FREQUENT) and the frequent patterns (at most 2,000). Cells get their source by a join of length counts per table, and later of the candidates alone.
Words, and the cells of stored contents, are merged with what they are joined with: plans estimate them by the size of
compressed files, however many rows come from these, and would send them through the driver.

Defined cases: null, empty and blank values are no cases; exact repeats count once; a table without a known source
belongs to the source -1; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators import nested
from tabweave.plans.common import written

FDR = 0.001
NEIGHBOURS = 12
FREQUENT = 0.04
LONGER = 0.002
BROKEN = 10
_ELLIPSIS = r"\s*(…|\.\.\.)\s*$"
_WORD = r"[\p{L}\p{N}]+"


def limits(counts: DataFrame, fdr: float = FDR, width: int = NEIGHBOURS) -> DataFrame:
    """counts: (field, source, unit, len, n). (field, source, unit, len, n, expected, longer) of the significant lengths;
    longer: the values that go on beyond."""
    of = Window.partitionBy("field", "source", "unit").orderBy("len")
    risk = counts.withColumn("risk", F.sum("n").over(Window.partitionBy("field", "source", "unit").orderBy(F.col("len").desc())))
    near = of.rangeBetween(-width, width)
    # a shorter length that no value has was passed by all values at risk here
    absent = F.greatest(F.least(F.lit(width), F.col("len") - 1) - F.count("*").over(of.rangeBetween(-width, -1)), F.lit(0))
    n0, r0 = F.sum("n").over(near) - F.col("n"), F.sum("risk").over(near) - F.col("risk") + absent * F.col("risk")
    tested = risk.withColumn("hazard", (n0 + 0.5) / (r0 + 1.0)).withColumn("expected", F.least(F.col("risk") * F.col("hazard"), F.col("risk").cast("double")))
    # a limit makes a peak of one length that few values pass; a favourite length of names has a slope on its left
    tested = tested.withColumn("beside", F.coalesce(F.max("n").over(of.rangeBetween(-3, -1)), F.lit(0)))
    # the logarithm of Chernoff's bound on P(Poisson(expected) >= n)
    bound = F.when(F.col("n") > F.col("expected"), -(F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected"))).otherwise(0.0)
    tested = tested.withColumn("log_p", bound)
    m = tested.agg(F.count("*").alias("m"))
    small = tested.where(F.col("log_p") < F.log(F.lit(fdr))).crossJoin(F.broadcast(m))  # m is one row
    small = small.withColumn("rank", F.row_number().over(Window.orderBy("log_p", "field", "source", "unit", "len")))
    passes = F.when(F.col("log_p") <= F.log(F.lit(fdr) * F.col("rank") / F.col("m")), F.col("rank"))
    last = F.max(passes).over(Window.partitionBy(F.lit(1)))
    kept = small.withColumn("last", last).where((F.col("rank") <= F.col("last")) & (F.col("n") >= 3 * F.col("expected")) & (F.col("n") >= 2.5 * F.col("beside")) & (2 * F.col("n") >= F.col("risk") - F.col("n")))
    return kept.select("field", "source", "unit", "len", "n", "expected", (F.col("risk") - F.col("n")).alias("longer"))


def _lengths(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts per unit and length of rows that have chars and bytes."""
    both = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len"))))
    return rows.groupBy(*by, "chars", "bytes").agg(F.count("*").alias("n")).select(*by, both.alias("u"), "n").groupBy(*by, "u.unit", "u.len").agg(F.sum("n").alias("n"))


def texts(tables: DataFrame) -> DataFrame:
    """(field, source, tableid, value, bare, ellipsis, page, chars, bytes) of titles and contexts; bare: without an ellipsis."""
    rows = tables.select(F.col("id").cast("long").alias("tableid"), F.coalesce("source", F.lit(-1)).alias("source"), "title", "context", F.coalesce("pagetitle", F.lit("")).alias("page")).where("tableid is not null").distinct()
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("title", "context"))))
    rows = rows.select("tableid", "source", "page", each.alias("x")).select("x.field", "source", "tableid", "x.value", F.when(F.col("x.field") == "title", F.col("page")).otherwise("").alias("page"))
    rows = rows.where(F.trim("value") != "").withColumn("ellipsis", F.col("value").rlike(_ELLIPSIS)).withColumn("bare", F.regexp_replace("value", _ELLIPSIS, ""))
    return rows.withColumns({"chars": F.length("bare"), "bytes": F.octet_length("bare")})


def word_counts(rows: DataFrame) -> DataFrame:
    """(field, w, n_inner, n_last): how often a word stands inside and at the end of the values of a field."""
    words = rows.select("field", F.regexp_extract_all("bare", F.lit(_WORD), F.lit(0)).alias("ws")).select("field", F.posexplode("ws").alias("i", "w"), F.size("ws").alias("k"))
    last = F.col("i") == F.col("k") - 1
    return words.groupBy("field", "w").agg(F.count_if(~last).alias("n_inner"), F.count_if(last).alias("n_last"))


def pattern(text: Column, frequent: list[str]) -> Column:
    """Frequent words and marks as they are, figures as one # per digit, any run of other words as _."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{N}+|[\p{L}\p{M}]+|[^\p{L}\p{N}\s]"), F.lit(0))
    shown = F.transform(parts, lambda x: F.when(x.rlike(r"^\p{N}"), F.regexp_replace(x, ".", "#")).when(x.rlike(r"^\p{L}"), F.when(x.isin(frequent), x).otherwise("_")).otherwise(x))
    return F.regexp_replace(F.concat_ws(" ", shown), r"_( _)+", "_")


def _titles(rows: DataFrame, at_limit: DataFrame, words: DataFrame) -> DataFrame:
    """(field, tableid, by) of the titles that are cut."""
    titles = rows.where("field = 'title'").join(at_limit, ["field", "tableid"], "left").withColumn("limit", F.coalesce("limit", F.lit(False)))
    n = titles.count()
    # at most (mean number of words) / FREQUENT words
    frequent = sorted(r[0] for r in words.where((F.col("field") == "title") & (F.col("n_inner") + F.col("n_last") >= max(2.0, FREQUENT * n))).select("w").collect())
    titles = titles.withColumn("pattern", pattern(F.col("bare"), frequent)).withColumn("w", F.element_at(F.regexp_extract_all("bare", F.lit(_WORD), F.lit(0)), -1 if n else 1))
    seen = titles.where(~F.col("limit") & ~F.col("ellipsis")).groupBy("pattern").agg(F.count("*").alias("n_pattern"))
    # at most 1 / 0.0005 patterns
    counts = {r["pattern"]: r["n_pattern"] for r in seen.where(F.col("n_pattern") >= max(2.0, 0.0005 * n)).collect()}
    whole = sorted(p for p, k in counts.items() if not any(q.startswith(p + " ") and counts[q] >= 5 * k for q in counts))
    many = F.array(*map(F.lit, whole)) if whole else F.array().cast("array<string>")
    short = F.regexp_replace("pattern", r" \S+$", "")
    begins = F.exists(many, lambda q: F.startswith(q, F.concat("pattern", F.lit(" "))) | F.startswith(q, F.concat(short, F.lit(" "))) & (short != F.col("pattern")))
    known = titles.select("pattern").distinct().withColumn("fits", F.col("pattern").isin(whole)).withColumn("begins", ~F.col("fits") & begins)
    # a frequent word may stand in the place of any other at the end
    known = known.withColumn("fits_blank", F.regexp_replace("pattern", r" [^ ]+$", " _").isin(whole) & F.col("pattern").rlike(r" \p{L}+$"))
    ends = words.where("field = 'title'").select("w", "n_inner", "n_last")
    # at most (mean number of words) / LONGER words, each with its beginnings
    long = words.where((F.col("field") == "title") & (F.col("n_inner") + F.col("n_last") >= max(5.0, LONGER * n)) & (F.length("w") > 1))
    heads = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr("w", F.lit(1), i)))
    ends = ends.join(long.select(heads.alias("w"), (F.col("n_inner") + F.col("n_last")).alias("longer")).groupBy("w").agg(F.max("longer").alias("longer")), "w", "left")
    t = titles.join(known, "pattern", "left").join(ends, "w", "left")
    rest = F.expr("substr(page, length(bare) + 1)")
    goes_on = F.col("page").startswith(F.col("bare")) & (F.length(rest) > 0)
    site = rest.rlike(r"^\s+[|–—·:-]\s") | rest.rlike(r"^\s*$")
    open_end = F.col("bare").rlike(r"[\s,;:–—(&/-]$")
    blank_end = F.col("pattern").endswith("_")
    own = F.col("n_last") - F.when(F.col("limit"), 0).otherwise(1)  # a value is no witness for itself
    final = F.coalesce(own >= F.when(F.col("limit"), 3).otherwise(1), F.lit(False)) & (F.col("n_last") * 25 >= F.col("n_inner"))
    fits = F.coalesce("fits", F.lit(False)) | F.coalesce("fits_blank", F.lit(False)) & final
    # whatever the pattern, and however often such pieces end a title at a limit
    broken = F.col("w").rlike(r"^\p{L}+$") & F.endswith("bare", "w") & (F.col("n_inner") == 0) & (F.col("longer") >= 5 * F.col("n_last"))
    at_limit_cut = ~(fits & (~blank_end | final)) | F.coalesce(broken, F.lit(False))
    with_ellipsis = F.when(F.col("limit"), at_limit_cut).otherwise(~fits & F.col("begins") | blank_end & (F.col("n_inner") > 10) & ~final)
    elsewhere = ~fits & F.coalesce("begins", F.lit(False)) & ~F.col("bare").rlike(r"[.!?)]$") | F.coalesce(broken, F.lit(False))
    cut = F.when(goes_on & ~site, True).when(goes_on & site & ~open_end, False).when(open_end, True).when(F.col("ellipsis"), with_ellipsis).when(F.col("limit"), at_limit_cut & ~F.col("bare").rlike(r"[.!?)]$")).otherwise(elsewhere)
    return t.where(cut).select("field", "tableid", F.when(F.col("limit"), "limit").otherwise("ending").alias("by"))


def _contexts(rows: DataFrame, at_limit: DataFrame, words: DataFrame) -> DataFrame:
    c = rows.where("field = 'context'").join(at_limit, ["field", "tableid"], "left").withColumn("limit", F.coalesce("limit", F.lit(False)))
    c = c.withColumn("w", F.try_element_at(F.regexp_extract_all("bare", F.lit(_WORD), F.lit(0)), F.lit(-1)))
    c = c.join(words.where("field = 'context'").select("w", "n_inner").hint("merge"), "w", "left")
    ended = F.col("bare").rlike(r"[.!?。؟][\"”“’')\]»]*\s*$")
    running = F.col("bare").rlike(r"[.!?。؟][\"”“’')\]»]*\s")
    listed = F.col("limit") | F.coalesce(F.col("n_inner") == 0, F.lit(True)) | F.col("bare").rlike(r"\s$")
    return c.where(F.when(ended, False).when(F.col("ellipsis") | running, True).otherwise(listed)).select("field", "tableid", F.when(F.col("limit"), "limit").otherwise("ending").alias("by"))


def truncated(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(field, tableid, colid, rowid, source, by) of the values that were cut; colid = rowid = -1 in titles and contexts."""
    rows = written(texts(tables), "texts")
    source = tables.where("id is not null").groupBy(F.col("id").cast("long").alias("tableid")).agg(F.coalesce(F.min("source"), F.lit(-1)).alias("source"))
    sized = cells.where("term is not null and term <> ''").select("tableid", "colid", "rowid", F.length("term").alias("chars"), F.octet_length("term").alias("bytes")).distinct()
    of_table = _lengths(sized, ["tableid"]).join(source, "tableid", "left").select(F.lit("term").alias("field"), F.coalesce("source", F.lit(-1)).alias("source"), "unit", "len", "n")
    counts = _lengths(rows, ["field", "source"]).unionByName(of_table.groupBy("field", "source", "unit", "len").agg(F.sum("n").alias("n")))
    found = written(limits(counts), "limits")

    at_limit = None
    for unit in ("chars", "bytes"):
        hit = rows.join(found.where(F.col("unit") == unit).select("field", "source", F.col("len").alias(unit)), ["field", "source", unit], "left_semi").select("field", "tableid")
        at_limit = hit if at_limit is None else at_limit.unionByName(hit)
    at_limit = at_limit.distinct().withColumn("limit", F.lit(True))
    words = written(word_counts(rows), "words")
    whole = _titles(rows, at_limit, words).unionByName(_contexts(rows, at_limit, words)).groupBy("field", "tableid").agg(F.max("by").alias("by"))
    whole = whole.join(source, "tableid", "left").select("field", "tableid", F.lit(-1).alias("colid"), F.lit(-1).alias("rowid"), "source", "by")

    # formats give cells of one length, too (dates, codes); a limit of the load has hardly any cell beyond it
    of_term = found.where("field = 'term' and n >= 2 * longer").select("source", "unit", "len")
    some = cells.where("term is not null").select("tableid", "colid", "rowid", F.length("term").alias("chars"), F.octet_length("term").alias("bytes"))
    near = None
    for unit in ("chars", "bytes"):
        at = of_term.where(F.col("unit") == unit)
        hit = some.join(at.select(F.col("len").alias(unit)).distinct(), unit, "left_semi").join(source, "tableid", "left").withColumn("source", F.coalesce("source", F.lit(-1)))
        hit = hit.join(at.select("source", F.col("len").alias(unit)), ["source", unit], "left_semi").select("tableid", "colid", "rowid")
        near = hit if near is None else near.unionByName(hit)
    cut = near.withColumn("by", F.lit("limit")).unionByName(continued(tables, cells).withColumn("by", F.lit("continued"))).unionByName(broken_cells(cells).withColumn("by", F.lit("ending")))
    cut = cut.groupBy("tableid", "colid", "rowid").agg(F.max("by").alias("by")).join(source, "tableid", "left")
    return whole.unionByName(cut.select(F.lit("term").alias("field"), "tableid", "colid", "rowid", "source", "by"))


def broken_cells(cells: DataFrame, times: int = BROKEN) -> DataFrame:
    """(tableid, colid, rowid) of the cells that end in a broken word. Counts are of all cells, combined per term first."""
    terms = cells.where("trim(term) <> ''").groupBy("term").agg(F.count("*").alias("k"))
    words = terms.select("k", "term", F.regexp_extract_all(F.lower("term"), F.lit(_WORD), F.lit(0)).alias("ws"))
    words = words.select("k", F.posexplode("ws").alias("i", "w"), F.size("ws").alias("size"))
    last = F.col("i") == F.col("size") - 1
    n = words.groupBy("w").agg(F.sum("k").alias("n"), F.sum(F.when(last, 0).otherwise(F.col("k"))).alias("n_inner"), F.count_if(last).alias("n_ends"))
    n = written(n, "cell-words")
    heads = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr("w", F.lit(1), i)))
    longer = n.where((F.col("n") >= times) & (F.length("w") > 1)).select(heads.alias("w"), "n").groupBy("w").agg(F.max("n").alias("longer"))
    broken = n.where("n_inner = 0 and n <= 2 * n_ends").where(F.col("w").rlike(r"^\p{L}+$")).join(longer.hint("merge"), "w").where(F.col("longer") >= times * F.col("n")).select("w")
    lower = F.lower("term")
    ended = cells.where("term is not null").select("tableid", "colid", "rowid", F.try_element_at(F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0)), F.lit(-1)).alias("w"), lower.alias("t"))
    return ended.where(F.endswith("t", "w")).join(broken, "w", "left_semi").select("tableid", "colid", "rowid")


def continued(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(tableid, colid, rowid) of the cells whose term stops where the same cell of the stored table goes on in a letter
    or figure: cut in mid-transfer, away from any limit."""
    shown = nested.nodes(tables.select("id", "content"), structure=False).where("role = 'cell' and text_value is not null")
    shown = shown.select(F.col("id").alias("tableid"), F.col("cell_pos").alias("colid"), F.col("tuple_pos").alias("rowid"), "text_value")
    own = cells.where("trim(term) <> ''").select("tableid", "colid", "rowid", "term")
    rest = F.expr("substr(text_value, length(term) + 1)")
    return own.join(shown.hint("merge"), ["tableid", "colid", "rowid"]).where(F.startswith("text_value", "term") & rest.rlike(r"^\s*[\p{L}\p{N}]")).select("tableid", "colid", "rowid")
