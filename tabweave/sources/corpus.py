"""The corpus: ingesting raw tables, loading tables, statistics, adding and removing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.functions.text import indexable, infer_type, normalize_cell, stem, url_host
from tabweave.plans.common import parallelism, written

#: One table of a dump, as a JSON line: the relation is column-major.
RAW = "relation array<array<string>>, hasHeader boolean, url string, domain string, title string, pageTitle string, termSet array<string>"


def numbered(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """df with a running number in the given order. Rows are numbered per range partition, plus the sizes of the earlier
    ones, so that no task sees all rows."""
    n = parallelism(df.sparkSession)
    ranged = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # one row per partition
    i = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + i - 1 + start).drop("__p", "__b")


def read_csv(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, header: bool = True, most: int | None = None) -> DataFrame:
    """Rows of CSV files as strings, at most `most`; rows with another number of fields than the first line are dropped, as
    the source table model does. Names come from the header if not given, or are COLUMN0, COLUMN1, .."""
    options = {"quote": '"', "escape": '"'}
    if columns is None:
        first = spark.read.csv(paths, header=header, **options).columns  # looks at one line
        columns = first if header else [f"COLUMN{i}" for i in range(len(first))]
    rows = spark.read.csv(paths, header=header, mode="DROPMALFORMED", schema=", ".join(f"`{c}` string" for c in columns), **options)
    return rows if most is None else rows.limit(most)


def load_file(spark: SparkSession, folder: str, name: str, header: bool = True) -> DataFrame:
    """The table stored as folder/name, with tid in the order of its lines."""
    rows = read_csv(spark, f"{folder.rstrip('/')}/{name}", header=header)
    return numbered(rows.withColumn("__o", F.monotonically_increasing_id()), ["__o"], "tid").drop("__o")


def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path): all .csv files below folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder).select("path")


def txt_to_csv(spark: SparkSession, source: str, target: str) -> None:
    """Text lines, fields separated by blanks or tabs, to quoted CSV."""
    quoted = F.transform(split_line(F.col("value")), lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))
    spark.read.text(source).select(F.array_join(quoted, ",").alias("value")).write.text(target)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, header=header, quote='"', escape='"', emptyValue="")


def run_script(spark: SparkSession, path: str) -> None:
    """Executes an SQL script, one statement per line."""
    for line in spark.read.text(path).toLocalIterator():
        statement = line["value"].strip().rstrip(";")
        if statement and not statement.startswith("--"):
            spark.sql(statement)


def catalog_columns(spark: SparkSession) -> DataFrame:
    """(table, column, position) of every table and view of the session."""
    rows = [(t.name, c.name, i) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table string, column string, position int")


def load_table(cells: DataFrame, tableid: int) -> DataFrame:
    """(colid, rowid, term): one point look-up, pushed to the scan."""
    return cells.where(F.col("tableid") == F.lit(tableid)).select("colid", "rowid", "term").distinct()


def load_tables(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """The cells of the tables in ids (tableid)."""
    from tabweave.operators.search import small

    return cells.join(small(ids.select("tableid").distinct()), "tableid", "left_semi")


def get_cell(cells: DataFrame, tableid: int, rowid: int, colid: int) -> DataFrame:
    return cells.where((F.col("tableid") == F.lit(tableid)) & (F.col("rowid") == F.lit(rowid)) & (F.col("colid") == F.lit(colid)))


def set_cell(cells: DataFrame, tableid: int, rowid: int, colid: int, term: str | None) -> DataFrame:
    """cells with another term in one place."""
    here = (F.col("tableid") == F.lit(tableid)) & (F.col("rowid") == F.lit(rowid)) & (F.col("colid") == F.lit(colid))
    new = F.lit(term).cast("string")
    out = cells.withColumn("term", F.when(here, new).otherwise(F.col("term")))
    return out.withColumn("tokenized", F.when(here, stem(new)).otherwise(F.col("tokenized"))) if "tokenized" in cells.columns else out


def idf_of(stored: DataFrame, terms: DataFrame) -> DataFrame:
    """terms (term). (term, idf) of those that are stored."""
    from tabweave.operators.search import small

    return stored.join(small(terms.select("term").distinct()), "term", "left_semi").select("term", "idf").distinct()


def read_lookup_files(spark: SparkSession, paths: list[str], n_columns: int) -> DataFrame:
    """Headerless CSV files as cells (file, colid, rowid, term)."""
    rows = read_csv(spark, paths, [f"c{i}" for i in range(n_columns)], header=False).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).withColumn("__r", F.monotonically_increasing_id())
    rowid = F.row_number().over(Window.partitionBy("file").orderBy("__r")) - 1
    return rows.withColumn("rowid", rowid).select("file", "rowid", F.posexplode(F.array(*(F.col(f"c{i}") for i in range(n_columns)))).alias("colid", "term"))


def split_line(line: Column) -> Column:
    """A text line to fields: two and more blanks or tabs separate."""
    return F.split(line, r"[ \t]{2,}|\t")


def unpivot(df: DataFrame, tableid: int, order: list[str]) -> DataFrame:
    """A flat table as cells (tableid, colid, rowid, term, tokenized); rowid follows the given order."""
    cells = numbered(df, order, "__row").select(F.col("__row").cast("int").alias("rowid"), F.posexplode(F.array(*(F.col(c).cast("string") for c in df.columns))).alias("colid", "term"))
    return cells.select(F.lit(tableid).cast("long").alias("tableid"), "colid", "rowid", indexable(F.col("term")).alias("term"), stem(indexable(F.col("term"))).alias("tokenized"))


def ingest_cells(raw: DataFrame) -> DataFrame:
    """raw (id, relation), column-major string matrices. Cells of the tables with at least two columns, normalised."""
    t = raw.where(F.size("relation") >= 2)
    columns = t.select(F.col("id").alias("tableid"), F.posexplode("relation").alias("colid", "column"))
    cells = columns.select("tableid", "colid", F.posexplode("column").alias("rowid", "raw")).select("tableid", "colid", "rowid", indexable(normalize_cell(F.col("raw"))).alias("term"))
    return cells.withColumn("tokenized", stem(F.col("term")))


def read_dump(spark: SparkSession, path: str, start: int = 1) -> DataFrame:
    """The tables of a folder of gzipped JSON lines, numbered from start in the order of files and lines: (id, file, RAW).
    Lines that are not a table are left out."""
    lines = spark.read.schema(RAW).json(path, mode="DROPMALFORMED").where("relation is not null")
    lines = lines.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).withColumn("__o", F.monotonically_increasing_id())
    return numbered(lines, ["file", "__o"], "id", start).drop("__o")


@dataclass
class Relations:
    """tables, columns and cells of a corpus."""

    tables: DataFrame
    columns: DataFrame
    cells: DataFrame


def ingest(raw: DataFrame, confidence: float = 0.5, source: int = 1) -> Relations:
    """raw (id, file, RAW) to relations. Columns stand in the order of their first cells, blank ones last; a table has a
    header row if its cells say so, or else if its dump says so; one with a header column is turned. Tables of fewer than
    two columns are left out. raw should be a written table."""
    first = F.coalesce(F.col("hasHeader"), F.lit(False))
    sorted_ = raw.select("id", first.alias("flag"), extract_table(F.col("relation"), F.lit(True)).alias("relation"))
    flat = sorted_.select("id", "flag", F.posexplode("relation").alias("colid", "column")).select("id", "flag", "colid", F.posexplode("column").alias("rowid", "raw"))
    flat = written(flat.select(F.col("id").alias("tableid"), "flag", "colid", "rowid", normalize_cell(F.col("raw")).alias("term"), F.trim("raw").alias("name")), "extracted")
    kind = detect_header(flat).join(flat.groupBy("tableid").agg(F.first("flag").alias("flag"), F.count_distinct("colid").alias("nc"), F.count_distinct("rowid").alias("nr")), "tableid", "right")
    kind = kind.select("tableid", "nc", "nr", F.when(F.coalesce("header", F.lit(0)) == 2, 2).when((F.coalesce("header", F.lit(0)) == 1) | F.col("flag"), 1).otherwise(0).alias("kind"))
    placed = flat.join(kind, "tableid").where(F.when(F.col("kind") == 2, F.col("nr")).otherwise(F.col("nc")) >= 2)
    turned = F.col("kind") == 2
    c, r = F.when(turned, F.col("rowid")).otherwise(F.col("colid")), F.when(turned, F.col("colid")).otherwise(F.col("rowid"))
    placed = placed.select("tableid", "kind", c.cast("int").alias("colid"), r.cast("int").alias("rowid"), "term", "name")
    head = placed.where("kind > 0 and rowid = 0").select("tableid", "colid", F.col("name").alias("header"), stem(F.col("name")).alias("header_tokenized"))
    body = placed.where("kind = 0 or rowid > 0").select("tableid", "colid", F.when(F.col("kind") > 0, F.col("rowid") - 1).otherwise(F.col("rowid")).alias("rowid"), "term")
    cells = body.select("tableid", "colid", "rowid", indexable(F.col("term")).alias("term"), stem(indexable(F.col("term"))).alias("tokenized"))
    names = head.groupBy("tableid").agg(F.array_sort(F.collect_list(F.struct("colid", "header"))).alias("h")).select("tableid", F.transform("h", lambda x: x["header"]).alias("columnNames"))
    value = F.struct(F.col("term").alias("value"))
    rows = body.groupBy("tableid", "rowid").agg(F.array_sort(F.collect_list(F.struct("colid", value.alias("cell")))).alias("c"))
    content = rows.groupBy("tableid").agg(F.array_sort(F.collect_list(F.struct("rowid", F.transform("c", lambda x: x["cell"]).alias("cells")))).alias("t"))
    content = content.join(names, "tableid", "left").select("tableid", F.size("t").alias("numrows"), F.to_json(F.struct(F.struct("columnNames").alias("schema"), F.transform("t", lambda x: F.struct(x["cells"].alias("cells"), x["rowid"].alias("tid"))).alias("tuples"))).alias("content"))
    host = F.coalesce("domain", url_host(F.coalesce("url", F.lit(""))))
    context = F.array_join("termSet", " ")
    meta = raw.select(F.col("id").alias("tableid"), F.concat_ws("#", "file", "id").alias("externalid"), "url", host.alias("domain"), "title", stem(F.col("title")).alias("title_tokenized"), F.col("pageTitle").alias("pagetitle"), stem(F.col("pageTitle")).alias("pagetitle_tokenized"), context.alias("context"), stem(context).alias("context_tokenized"))
    tables = meta.join(content, "tableid").select(F.col("tableid").alias("id"), "externalid", "numrows", "url", "domain", "title", "title_tokenized", "pagetitle", "pagetitle_tokenized", "context", "context_tokenized", "content", F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(0).alias("openrank"))
    return Relations(tables, head, cells)


class Store:
    """A corpus in a folder: three relations partitioned by source, cells sorted by table, and a second copy of the cells
    sorted by token for searches. Tables are added by appending; those of added sources go by dropping their partitions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, r: Relations, source: int = 1, confidence: float | None = None) -> None:
        tables = r.tables.drop("source") if confidence is None else r.tables.drop("source").withColumn("confidence", F.lit(confidence))
        keep = lambda df: df.withColumn("source", F.lit(source)).write.partitionBy("source").mode("append")
        keep(tables).parquet(f"{self.root}/tables")
        keep(r.columns).parquet(f"{self.root}/columns")
        keep(r.cells.sortWithinPartitions("tableid", "colid", "rowid")).parquet(f"{self.root}/cells")
        n = parallelism(self.spark)
        keep(r.cells.repartition(n, "tokenized", F.pmod(F.xxhash64("tableid"), F.lit(8))).sortWithinPartitions("tokenized", "tableid")).parquet(f"{self.root}/cells_by_token")

    def read(self, relation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{relation}")

    def remove_added(self, original: int = 1) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for relation in ("tables", "columns", "cells", "cells_by_token"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relation}")
            fs = path.getFileSystem(conf)
            for f in fs.listStatus(path):
                name = f.getPath().getName()
                if name.startswith("source=") and int(name[7:]) > original:
                    fs.delete(f.getPath(), True)


def extract_table(relation: Column, header_row: Column) -> Column:
    """A column-major relation with its columns in the order of their headers, blank headers last."""
    keyed = F.transform(relation, lambda c, i: F.struct((~header_row | (F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("")) == "")).alias("blank"), F.when(header_row, F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))).alias("h"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def detect_header(cells: DataFrame) -> DataFrame:
    """(tableid, header): 1 (a header row) if three quarters of the first row end in a colon, or the first row is of type
    STRING and some column is not; else 2 (a header column) if the first column is STRING and some row's other cells are
    not; else 0."""
    c = cells.where("term is not null")
    colon = F.count_if(F.col("term").rlike(r":[^A-Za-z0-9_]*$")) >= 0.75 * F.count("*")
    first_row = c.where("rowid = 0").groupBy("tableid").agg(colon.alias("colon"), infer_type(F.col("term")).alias("row_type"))
    first_col = c.where("colid = 0").groupBy("tableid").agg(infer_type(F.col("term")).alias("col_type"))
    other = lambda df, axis, name: df.groupBy("tableid", axis).agg(infer_type(F.col("term")).alias("t")).groupBy("tableid").agg(F.bool_or(F.col("t") != "STRING").alias(name))
    t = c.select("tableid").distinct().join(first_row, "tableid", "left").join(first_col, "tableid", "left")
    t = t.join(other(c, "colid", "by_row"), "tableid", "left").join(other(c.where("colid > 0"), "rowid", "by_col"), "tableid", "left")
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    header = F.when(yes("colon"), 1).when((F.col("row_type") == "STRING") & yes("by_row"), 1).when((F.col("col_type") == "STRING") & yes("by_col"), 2).otherwise(0)
    return t.select("tableid", header.alias("header"))


def column_types(cells: DataFrame) -> DataFrame:
    """(tableid, colid, type); null for a column without a value."""
    return cells.groupBy("tableid", "colid").agg(infer_type(F.col("term")).alias("type"))


def idf(cells: DataFrame, integer_division: bool = True) -> DataFrame:
    """(term, number_occurence, idf): ln(tables / tables with the term); the ratio is cut to an integer unless told not to."""
    n = F.broadcast(cells.agg(F.count_distinct("tableid").alias("n")))  # one row
    df = cells.where("tokenized <> ''").groupBy("tokenized", "tableid").agg(F.count("*")).groupBy("tokenized").agg(F.count("*").alias("number_occurence"))
    ratio = F.floor(F.col("n") / F.col("number_occurence")) if integer_division else F.col("n") / F.col("number_occurence")
    return df.crossJoin(n).select(F.col("tokenized").alias("term"), "number_occurence", F.log(ratio.cast("double")).alias("idf"))


def untokenize(cells: DataFrame) -> DataFrame:
    """(tableid, tokenized, term): the written form of a token at its first place in the table."""
    return cells.where("tokenized <> '' and term is not null").groupBy("tableid", "tokenized").agg(F.min_by("term", F.struct("colid", "rowid")).alias("term"))


def union_tables(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Cells of the tables of each union one below the other: (unionid, colid, rowid, tokenized), members by id."""
    m = members.select("tableid", "unionid").distinct()
    sizes = cells.groupBy("tableid").agg((F.max("rowid") + 1).alias("n")).join(m, "tableid")
    before = F.sum("n").over(Window.partitionBy("unionid").orderBy("tableid")) - F.col("n")
    placed = sizes.withColumn("before", before).select("tableid", "unionid", "before")
    return cells.select("tableid", "colid", "rowid", "tokenized").distinct().join(placed, "tableid").select("unionid", "colid", (F.col("before") + F.col("rowid")).alias("rowid"), "tokenized")


def remove_added(tables: DataFrame, cells: DataFrame, original: int = 1) -> DataFrame:
    """cells without those of tables that another source than the original added."""
    return cells.join(tables.where(F.col("source") > original).select(F.col("id").alias("tableid")).distinct(), "tableid", "left_anti")


def write_by_token(cells: DataFrame, path: str, files: int) -> None:
    """The second copy, for search: hash-segmented and sorted by token."""
    cells.repartition(files, "tokenized", F.pmod(F.xxhash64("tableid"), F.lit(8))).sortWithinPartitions("tokenized", "tableid").write.parquet(path)


def write_by_domain(rows: DataFrame, path: str) -> None:
    """One folder per domain with gzip text, dots as dashes; hot domains are spread over several files."""
    d = F.translate(F.coalesce(F.col("domain"), F.lit("none")), ".", "-")
    rows.select(d.alias("domain"), F.col("line").alias("value")).repartition("domain", F.pmod(F.xxhash64("value"), F.lit(8))).write.partitionBy("domain").text(path, compression="gzip")


def term_set_counts(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("termSet").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_NT = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*\.\s*$'


def parse_triples(lines: DataFrame) -> DataFrame:
    """lines (value) of N-Triples. (subject, predicate, object, object_tokenized); other lines are left out."""
    ok = lines.where(F.col("value").rlike(_NT))
    part = lambda i: F.regexp_extract("value", _NT, i)
    o = F.when(part(3) != "", part(3)).otherwise(part(4))
    return ok.select(part(1).alias("subject"), part(2).alias("predicate"), o.alias("object"), F.when(part(3) == "", stem(part(4))).alias("object_tokenized"))
