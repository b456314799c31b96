"""Look-up programs over a cell relation: which columns hold an input, what stands beside it, and how that becomes the output.

cells (tableid, colid, rowid, term): raw, case-sensitive terms.

A program is a set of chains and a string program. A chain starts where an input (or a term inside it) stands and goes
through one or two tables, from a column to another one of the same row; tables are joined on shared values. If several
rows are reached, those that also hold the most of the input's other parts go on. The string program puts the values of the
chains and the parts of the input together. generate() runs all chains on all examples by joins; learn() keeps what
reproduces every example; apply() runs one program on any number of inputs, set at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators import strings
from tabweave.plans.common import written

#: Inputs compared with all terms at a time, where no equality finds them.
BLOCK = 1_000


def catalog_keys(cells: DataFrame) -> DataFrame:
    """(tableid, colid): every column is a candidate key."""
    return cells.select("tableid", "colid").distinct()


def find_data_keys(cells: DataFrame, inputs: DataFrame) -> DataFrame:
    """inputs (term). (tableid, colid) of the columns that hold an input exactly."""
    from tabweave.operators.search import small

    return cells.join(small(inputs.select("term").distinct()), "term", "left_semi").select("tableid", "colid").distinct()


def all_data_keys(cells: DataFrame, inputs: DataFrame, least: float = 0.77) -> DataFrame:
    """inputs (input). (input, term, kind): the best term for each input. Terms that contain the input or stand in it
    (kind 0) come first, the longest of them; else the one of greatest similarity above `least` (kind 1), whose length can
    differ only so much. The inputs are a stated query set: they are compared with each different term in blocks of BLOCK."""
    terms = cells.where("term is not null and term <> ''").select("term").distinct()
    rows = sorted(r["input"] for r in inputs.where("input <> ''").select("input").distinct().toLocalIterator())
    inside = F.col("term").contains(F.col("input")) | F.col("input").contains(F.col("term"))
    longer, shorter = F.greatest(F.length("term"), F.length("input")), F.least(F.length("term"), F.length("input"))
    sim = F.when(shorter > least * longer, 1 - F.levenshtein("term", "input") / longer).otherwise(0.0)
    out = cells.sparkSession.createDataFrame([], "input string, term string, kind int, sim double")
    for at in range(0, len(rows), BLOCK):
        block = cells.sparkSession.createDataFrame([(r,) for r in rows[at : at + BLOCK]], "input string")
        met = terms.join(F.broadcast(block), inside | (sim > least)).select("input", "term", F.when(inside, 0).otherwise(1).alias("kind"), sim.alias("sim"))
        out = out.unionByName(met)
    i = F.row_number().over(Window.partitionBy("input").orderBy("kind", F.when(F.col("kind") == 0, -F.length("term")), F.col("sim").desc(), "term"))
    return out.withColumn("i", i).where("i = 1").select("input", "term", "kind")


def lookup(cells: DataFrame, params: dict[int, list[str]], tableid: int, dest: int) -> DataFrame:
    """(rowid, term): the dest cell of the rows in which, for every source column, some cell is in its parameter list."""
    t = cells.where(F.col("tableid") == tableid)
    rows = t.select("rowid").distinct()
    for values in params.values():
        rows = rows.join(t.where(F.col("term").isin(values)).select("rowid").distinct(), "rowid", "left_semi")
    return t.where(F.col("colid") == dest).join(rows, "rowid", "left_semi").select("rowid", "term").distinct()


def find_all(cells: DataFrame, inputs: DataFrame) -> DataFrame:
    """inputs (input). (input, tableid, colid, term): the first row of each table that holds the input."""
    from tabweave.operators.search import small

    first = cells.join(small(inputs.select(F.col("input").alias("term"), "input").distinct()), "term").groupBy("input", "tableid").agg(F.min("rowid").alias("rowid"))
    return first.join(cells, ["tableid", "rowid"]).select("input", "tableid", "colid", "term").distinct()


def chain(cells: DataFrame, inputs: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """steps (tableid, from column, to column): each input looked up through the tables one after the other, set at a
    time. (input, value); the smallest value where several are reached."""
    at = inputs.select("input", F.col("input").alias("value")).distinct()
    for tableid, source, dest in steps:
        t = cells.where(F.col("tableid") == tableid)
        m = t.where(F.col("colid") == source).select("rowid", F.col("term").alias("value")).join(t.where(F.col("colid") == dest).select("rowid", F.col("term").alias("next")), "rowid").select("value", "next").distinct()
        at = at.join(m, "value").groupBy("input").agg(F.min("next").alias("value"))
    return at


@dataclass(frozen=True)
class Step:
    tableid: int
    source: int
    dest: int


@dataclass(frozen=True)
class Program:
    """chains, each a sequence of steps that starts at an input part; parts: the string program over the chains' values and
    the input parts; by_word: it is run on each word of the input, and the outputs are joined by blanks."""

    chains: tuple[tuple[Step, ...], ...]
    parts: tuple[strings.Part, ...]
    by_word: bool = False


def _support(parts: Column, term: Column) -> Column:
    """How many input parts the term holds or stands in."""
    return F.size(F.filter(parts, lambda p: (F.length(term) > 1) & (term.contains(p) | p.contains(term))))


def _beside(cells: DataFrame, at: DataFrame, step: Step | None, table_changes: bool = False) -> DataFrame:
    """at (id, parts, path, last, value). One step on: for each column beside the value (or by the step given), the value in
    the row that holds most of the input's parts, the smallest of them if several do."""
    from tabweave.operators.search import small

    c = cells.where("term is not null and term <> ''")
    source = c.where((F.col("tableid") == step.tableid) & (F.col("colid") == step.source)) if step else c
    keys = small(at.select("value").distinct())
    met = source.join(keys, source["term"] == keys["value"], "left_semi").select("tableid", "rowid", F.col("colid").alias("sc"), F.col("term").alias("value")).distinct()
    hit = at.join(met, "value")
    if table_changes:
        hit = hit.where(F.col("tableid") != F.col("last"))
    rows = c.join(small(met.select("tableid", "rowid").distinct()), ["tableid", "rowid"], "left_semi").select("tableid", "rowid", F.col("colid").alias("dc"), "term").distinct()
    wide = hit.join(rows, ["tableid", "rowid"])
    own = ["id", "path", "tableid", "sc", "rowid"]
    held = wide.groupBy(*own, "value").agg(F.sum(F.when(F.col("dc") != F.col("sc"), _support(F.col("parts"), F.col("term"))).otherwise(0)).alias("support"))
    wide = wide.join(held, [*own, "value"]).where("dc <> sc")
    if step:
        wide = wide.where(F.col("dc") == step.dest)
    best = F.min(F.struct((-F.col("support")).alias("s"), F.col("term").alias("t")))
    to = F.concat_ws(":", "tableid", "sc", "dc")
    return wide.groupBy("id", "parts", F.concat_ws(">", F.nullif("path", F.lit("")), to).alias("path"), F.col("tableid").alias("last")).agg(best.alias("b")).select("id", "parts", "path", "last", F.col("b.t").alias("value"))


def starts(cells: DataFrame, inputs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """inputs (id, parts). (id, parts, path, last, value): each input part as it stands in the cells, or the term it holds."""
    each = inputs.select("id", "parts", F.explode("parts").alias("input")).distinct()
    terms = cells.where("term is not null").select(F.col("term").alias("value")).distinct()
    exact = each.join(terms, each["input"] == terms["value"], "left").select("id", "parts", "input", "value")
    found = exact.where("value is not null")
    if fuzzy:
        rest = exact.where("value is null")
        near = all_data_keys(cells, rest.select("input")).select("input", F.col("term").alias("value"))
        found = found.unionByName(rest.drop("value").join(near, "input").select("id", "parts", "input", "value"))
    return found.select("id", "parts", F.lit("").alias("path"), F.lit(-1).cast("long").alias("last"), "value").distinct()


def generate(cells: DataFrame, examples: DataFrame, hops: int = 2, fuzzy: bool = True) -> DataFrame:
    """examples (id, parts, y). (path, id, value): what every chain of up to `hops` tables gives for each example."""
    cells = cells.select("tableid", "colid", "rowid", "term")
    at = written(starts(cells, examples.select("id", "parts"), fuzzy), "starts")
    out = None
    for i in range(hops):
        at = written(_beside(cells, at, None, i > 0), "chains")
        out = at if out is None else out.unionByName(at)
    return out.select("path", "id", "value").distinct()


def _steps(path: str) -> tuple[Step, ...]:
    return tuple(Step(*map(int, p.split(":"))) for p in path.split(">"))


def learn(cells: DataFrame, examples: list[tuple[list[str], str]], most: int = 200, hops: int = 2) -> Program | None:
    """The best program that reproduces all examples (but for case), or None. Chains count if their value shares text with
    the output of every example (or is its reason: one chain alone need not); the `most` with the longest shared text are
    tried alone and in pairs, those with fewer steps first."""
    # at least three pairs of words that one program explains say more than the whole texts
    words = [(x[0].split(), out.split()) for x, out in examples if len(x) == 1]
    if len(words) == len(examples) and all(len(a) == len(b) > 1 for a, b in words) and sum(len(a) for a, _ in words) > 2:
        one = learn(cells, [([a], b) for x, out in words for a, b in zip(x, out)], most, hops)
        if one:
            return Program(one.chains, one.parts, True)
    spark = cells.sparkSession
    rows = spark.createDataFrame([(i, list(x), y) for i, (x, y) in enumerate(examples)], "id int, parts array<string>, y string")
    y, v = F.lower("y"), F.lower("value")
    shared = generate(cells, rows, hops).join(F.broadcast(rows), "id").where(y.contains(v) | v.contains(y) | F.exists(F.split("value", r"[^\p{L}\p{N}.]+"), lambda w: (F.length(w) > 1) & F.col("y").contains(w)))
    ranked = shared.groupBy("path").agg(F.count_distinct("id").alias("n"), F.sum(F.least(F.length("value"), F.length("y"))).alias("len"), F.map_from_entries(F.collect_set(F.struct("id", "value"))).alias("values"))
    tried = ranked.where(F.col("n") == len(examples)).orderBy(F.col("len").desc(), F.length("path"), "path").limit(most).collect()
    found: list[tuple[tuple, Program]] = []

    def attempt(chains: list) -> None:
        lines = [([c["values"][i] for c in chains] + list(x), out) for i, (x, out) in enumerate(examples)]
        parts = strings.learn(lines)
        if parts is None or any((strings.run(parts, x) or "").lower() != out.lower() for x, out in lines):
            return
        used = {p.source for p in parts if p.text is None}
        if not all(k in used for k in range(len(chains))):
            return
        steps = tuple(_steps(c["path"]) for c in chains)
        found.append(((-strings.score(parts), sum(map(len, steps)), str(steps)), Program(steps, tuple(parts))))

    for c in tried:
        attempt([c])
    if not found:
        for i, a in enumerate(tried):
            for b in tried[i + 1 :]:
                attempt([a, b])
    if found:
        return min(found, key=lambda x: x[0])[1]
    lines = [(list(x), out) for x, out in examples]
    if len(examples) > 1 and (parts := strings.learn(lines)) is not None and strings.score(parts) > 0:
        return Program((), tuple(parts))
    return None


def apply(program: Program, cells: DataFrame, inputs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """inputs (id, parts). (id, output): null where a chain finds nothing. One join per step, however many inputs."""
    cells = cells.select("tableid", "colid", "rowid", "term")
    if program.by_word:
        words = inputs.select("id", F.posexplode(F.split(F.trim(F.col("parts")[0]), r"\s+")).alias("at", "w")).select(F.struct("id", "at").alias("id"), F.array("w").alias("parts"))
        one = apply(Program(program.chains, program.parts), cells, words, fuzzy)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id.at", "output"))), lambda x: x["output"]), " ")
        return one.groupBy("id.id").agg(F.when(F.count("*") == F.count("output"), joined).alias("output"))
    out = inputs.select("id", "parts")
    names = []
    for i, steps in enumerate(program.chains):
        first = cells.where((F.col("tableid") == steps[0].tableid) & (F.col("colid") == steps[0].source))
        at = starts(first, inputs, fuzzy)
        for k, step in enumerate(steps):
            at = _beside(cells.where(F.col("tableid") == step.tableid), at, step, False)
        name = f"__c{i}"
        names.append(name)
        out = out.join(at.groupBy("id").agg(F.min("value").alias(name)), "id", "left")
    n = len(program.chains)
    width = max((p.source for p in program.parts if p.text is None), default=0) - n + 1
    columns = [F.col(c) for c in names] + [F.get(F.col("parts"), F.lit(k)) for k in range(max(0, width))]
    return out.select("id", strings.compile_program(list(program.parts), columns).alias("output"))


class LookUp:
    """Learning from one example after the other. An example that no program explains together with the earlier ones is
    refused and leaves the state as it was."""

    def __init__(self, cells: DataFrame, hops: int = 2):
        self.cells = written(cells.where("term is not null").select("tableid", "colid", "rowid", "term").distinct(), "cells")
        self.hops = hops
        self.examples: list[tuple[list[str], str]] = []
        self.program: Program | None = None

    def provide_example(self, inputs: str | list[str], output: str) -> bool:
        more = [*self.examples, ([inputs] if isinstance(inputs, str) else list(inputs), output)]
        program = learn(self.cells, more, hops=self.hops)
        if program is None:
            return False
        self.examples, self.program = more, program
        return True

    def find_match(self, *inputs: str) -> str | None:
        """The output for one input; for many inputs, use find_matches."""
        rows = self.cells.sparkSession.createDataFrame([(0, list(inputs))], "id int, parts array<string>")
        return self.find_matches(rows).first()["output"]

    def find_matches(self, inputs: DataFrame) -> DataFrame:
        """inputs (id, parts). (id, output)."""
        if self.program is None:
            raise ValueError("no example has been learned")
        return apply(self.program, self.cells, inputs)


def longest(values: DataFrame) -> DataFrame:
    """values (g, i, s). (g, s): the first string of maximal length."""
    return values.groupBy("g").agg(F.max_by("s", F.struct(F.length("s"), -F.col("i"))).alias("s"))


def split_examples(pairs: DataFrame, first: int = 3) -> DataFrame:
    """pairs (i, x, y). (x, y) word pairs of the first examples: a single-word y takes every word of x longer than one
    character; equal numbers of words align by place, words that several examples share are left out."""
    p = pairs.orderBy("i").limit(first).select("i", F.split(F.trim("x"), r"\s+").alias("xs"), F.split(F.trim("y"), r"\s+").alias("ys"))
    one = p.where(F.size("ys") == 1).select(F.explode("xs").alias("x"), F.col("ys")[0].alias("y")).where(F.length("x") > 1)
    many = p.where(F.size("ys") > 1)
    def kept(side: str) -> DataFrame:
        w = many.select("i", F.posexplode(side).alias("at", "w"))
        shared = w.groupBy("w").agg(F.count_distinct("i").alias("n")).where("n > 1").select("w")
        left = w.join(shared, "w", "left_anti")
        return left.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda z: z["w"]).alias(side))
    both = kept("xs").join(kept("ys"), "i").where(F.size("xs") == F.size("ys")).select(F.explode(F.arrays_zip("xs", "ys")).alias("z")).select(F.col("z.xs").alias("x"), F.col("z.ys").alias("y"))
    return one.unionByName(both).distinct()
