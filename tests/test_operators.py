import pytest
from pyspark.sql import functions as F

from tabweave.functions import text
from tabweave.operators import em, evaluate, fd, forms, graph, indirect, lookup, match, score, search, strings
from tabweave.sources import corpus


def test_string_programs():
    for examples, inputs, want in (
        ([(["0.82", "10 USD"], "0.82 * 10")], ["0.81", "20 USD"], "0.81 * 20"),
        ([(["John Smith"], "J. Smith"), (["Anna Bell"], "A. Bell")], ["Mia Stone"], "M. Stone"),
        ([(["1995-03-07"], "07/03/1995"), (["2001-11-25"], "25/11/2001")], ["1999-01-02"], "02/01/1999"),
        ([(["abc"], "ABC"), (["x y"], "X Y")], ["hello"], "HELLO"),
    ):
        parts = strings.learn(examples)
        assert "".join(p.run(inputs) for p in parts) == want
    assert strings.learn([(["a"], "1"), (["b"], "2")]) is None


def test_string_programs_by_position():
    for examples, inputs, want in (
        ([(["20110305"], "2011-03-05"), (["19991231"], "1999-12-31")], ["20200107"], "2020-01-07"),
        ([(["9780306406157"], "978-0-306-40615-7"), (["9781861972712"], "978-1-861-97271-2")], ["9783161484100"], "978-3-161-48410-0"),
        ([(["a bb c d e f"], "f e d c bb a"), (["g h i j kk l"], "l kk j i h g")], ["1 2 3 4 5 6"], None),
        ([(["aa bb cc dd ee ff"], "ff ee dd cc bb aa"), (["g h i j kk l"], "l kk j i h g")], ["q w e r t y"], "y t r e w q"),
    ):
        parts = strings.learn(examples)
        if want:
            assert strings.run(parts, inputs) == want


def table_cells(spark, *tables):
    rows = [(t, c, r, v) for t, rows in enumerate(tables) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "tableid int, colid int, rowid int, term string")


def test_look_up_with_string_program(spark):
    people = [("044-58-3429", "Steve", "Russell", "m"), ("027-36-4557", "John", "Henry", "m"), ("034-83-7683", "William", "Johnson", "m"), ("011-11-1111", "Ann", "Moor", "f")]
    l = lookup.LookUp(table_cells(spark, people))
    assert l.provide_example("044-58-3429", "Mr. Steve Russell") and l.provide_example("027-36-4557", "Mr. John Henry")
    assert l.find_match("034-83-7683") == "Mr. William Johnson"
    assert not l.provide_example("034-83-7683", "nothing of the kind")
    many = spark.createDataFrame([(i, [p[0]]) for i, p in enumerate(people)] + [(9, ["unknown"])], "id int, parts array<string>")
    assert {r["id"]: r["output"] for r in l.find_matches(many).collect()} == {0: "Mr. Steve Russell", 1: "Mr. John Henry", 2: "Mr. William Johnson", 3: "Mr. Ann Moor", 9: None}


def test_look_up_of_a_part_of_the_input(spark):
    l = lookup.LookUp(table_cells(spark, [("Algeria", "Algiers"), ("Angola", "Luanda"), ("Egypt", "Cairo"), ("Tunisia", "Tunis")]))
    assert l.provide_example("Land: Algeria", "City: Algiers") and l.provide_example("Land: Angola", "City: Luanda")
    assert [l.find_match(f"Land: {x}") for x in ("Egypt", "Tunisia")] == ["City: Cairo", "City: Tunis"]


def test_look_up_through_two_tables(spark):
    sales = [("Peter Shaw", "s1"), ("Gary Limb", "s2"), ("Mike Henry", "s3"), ("Sean Riley", "s4")]
    l = lookup.LookUp(table_cells(spark, sales, [("s1", "110"), ("s2", "225"), ("s3", "2015"), ("s4", "495")]))
    assert l.provide_example("Peter Shaw", "110")
    assert [l.find_match(x) for x in ("Gary Limb", "Mike Henry", "Sean Riley")] == ["225", "2015", "495"]


def test_look_up_narrowed_by_the_other_inputs(spark):
    bikes = [("Ducati", "100", "10.000"), ("Ducati", "125", "12.500"), ("Ducati", "250", "18.000"), ("Honda", "125", "11.500"), ("Honda", "250", "19.000")]
    l = lookup.LookUp(table_cells(spark, bikes))
    assert l.provide_example(["Honda", "125"], "11.500")
    assert [l.find_match(*x) for x in (("Ducati", "100"), ("Honda", "250"), ("Ducati", "250"))] == ["10.000", "19.000", "18.000"]


def test_look_up_word_by_word(spark):
    l = lookup.LookUp(table_cells(spark, [("c1", "Microsoft"), ("c2", "Google"), ("c3", "Apple"), ("c4", "Facebook"), ("c5", "IBM"), ("c6", "Xerox")]))
    assert l.provide_example("c4 c3 c1", "Facebook Apple Microsoft")
    assert l.find_match("c2 c5 c6") == "Google IBM Xerox"


def test_string_program_as_column(spark):
    parts = strings.learn([(["Customer#000000012"], "C-12"), (["Customer#000000907"], "C-907")])
    df = spark.createDataFrame([("Customer#000000100",), ("nothing",)], "c string")
    assert [r[0] for r in df.select(strings.compile_program(parts, [F.col("c")])).collect()] == ["C-100", None]


def test_fd_golden(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "a", "x"), ("3", "b", "y"), ("3", "b", "y")], "a string, b string, c string")
    assert fd.dependencies(df, ["a", "b", "c"], 0.0, 2) == [(("a",), "b"), (("a",), "c"), (("b",), "c"), (("c",), "b")]
    assert fd.candidate_keys(df.distinct(), ["a", "b", "c"]) == [("a",)]
    assert fd.closure({"a"}, [(("a",), "b"), (("b",), "c")]) == {"a", "b", "c"}


def test_hungarian():
    w = {(0, 0): 5.0, (0, 1): 6.0, (1, 1): 5.0, (1, 0): 1.0}
    assert sorted(match.assign(w, 2, 2)) == [(0, 0), (1, 1)]
    assert sorted(match.assign({(0, 2): 3.0}, 1, 3)) == [(0, 2)]


def test_scores_of_a_key_sum_to_one_at_most(spark):
    ans = spark.createDataFrame([("t1", "k", "a"), ("t2", "k", "b"), ("t3", "k", "a"), ("t1", "q", "z")], "mid string, k string, v string")
    r = spark.createDataFrame([("t1", 0.9), ("t2", 0.5), ("t3", 1.0)], "mid string, rating double")
    total = {x["k"]: x["s"] for x in score.score_functional(ans, r).groupBy("k").agg(F.sum("score").alias("s")).collect()}
    assert all(0 <= s <= 1 + 1e-9 for s in total.values())
    best = {(x["k"], x["v"]) for x in score.best_per_key(score.score_functional(ans, r)).collect()}
    assert ("k", "a") in best
    both = spark.createDataFrame([("u1", 1.0), ("u2", 1.0)], "mid string, rating double")
    clash = spark.createDataFrame([("u1", "k", "a"), ("u2", "k", "b")], "mid string, k string, v string")
    assert {x["score"] for x in score.score_functional(clash, both).collect()} == {0.0}


def test_em_converges(spark):
    ans = spark.createDataFrame([("t1", "k1", "a"), ("t1", "k2", "b"), ("t2", "k1", "x"), ("t2", "k2", "c")], "mid string, k string, v string")
    fixed = spark.createDataFrame([("k1", "a", 1.0)], "k string, v string, score double")
    tables = spark.createDataFrame([("t1", 0.5, 0.5), ("t2", 0.5, 0.5)], "mid string, prior double, schema double")
    _, examples, n = em.run(ans, fixed, tables, 12)
    assert {(r["k"], r["v"]) for r in examples.collect()} == {("k1", "a"), ("k2", "b")}
    truth = {(r["k"], r["v"]): r["truth"] for r in em.latent_truth(ans).collect()}
    assert len(truth) == 4 and all(0 <= t <= 1 for t in truth.values())


def test_text_and_evaluation(spark):
    df = spark.createDataFrame([("&nbsp;",), ("?",), (" a  b ",), ("NULL",), ("-",), (None,)], "c string")
    assert [r[0] for r in df.select(text.normalize_cell(F.col("c"))).collect()] == [None, None, "a b", None, None, None]
    df = spark.createDataFrame([("The Hague",), ("...",)], "c string")
    assert [r[0] for r in df.select(text.stem(F.col("c"))).collect()] == ["hague", ""]
    found = spark.createDataFrame([("a", "1"), ("b", "x")], "k string, v string")
    truth = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string")
    r = evaluate.precision_recall(found, truth).first()
    assert (r["correct"], r["answered"], r["total"]) == (1, 2, 3)


def test_forms(spark):
    html = "<form method=POST><input name=q><input type=submit name=go><select name=s></select></form><p>hello</p>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert {(r["method"], r["name"], r["kind"]) for r in forms.forms(pages).collect()} == {("post", "q", "text"), ("post", "go", "submit"), ("post", "s", "select")}
    out = forms.through(spark.createDataFrame([("a",)], "x string"), lambda x: f"<div><b>{x}!</b></div>", ["/div/b"])
    assert out.first()["y"] == "a!"


def test_wrapper_is_found_by_examples(spark):
    page = "<form action=a><input type=checkbox name=c></form><form method=POST><input name=login><input type=text name=q><input type=submit name=no><input type=submit name=go></form>"
    capitals = {"Peru": "Lima", "Chad": "N'Djamena", "Oman": "Muscat"}

    def send(form, method, field, submit, x):
        answer = capitals.get(x, "") if (form, method, field, submit) == (1, "post", "q", "go") else "error"
        return f"<h1>Answers for you</h1><div><p>{answer}</p><p>all of {answer} and more</p></div>"

    w = forms.find_wrapper(page, [("Peru", "Lima"), ("Chad", "N'Djamena")], send)
    assert (w.form, w.method, w.field, w.submit, w.path) == (1, "post", "q", "go", "/div/p")
    out = forms.through(spark.createDataFrame([("Oman",), ("Nowhere",)], "x string"), lambda x: send(w.form, w.method, w.field, w.submit, x), [w.path])
    assert {r["x"]: r["y"] for r in out.collect()}["Oman"].endswith("Muscat")
    assert forms.find_wrapper(page, [("Peru", "Oslo"), ("Chad", "Rome")], send) is None
    assert forms.find_wrapper("<p>no form</p>", [("a", "b")], send) is None


def test_csv_and_triples(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    assert corpus.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect() == [("1", "2"), ("7", "8")]
    lines = spark.createDataFrame([('<s> <p> "The Name"@en .',), ("<s> <p> <o> .",), ("junk",)], "value string")
    assert {(r["object"], r["object_tokenized"]) for r in corpus.parse_triples(lines).collect()} == {("The Name", "name"), ("o", None)}


def test_split_examples_golden(spark):
    p = spark.createDataFrame([(1, "Mr Steve Russell", "Steve")], "i int, x string, y string")
    assert {(r["x"], r["y"]) for r in lookup.split_examples(p).collect()} == {("Mr", "Steve"), ("Steve", "Steve"), ("Russell", "Steve")}


def test_unpivot_numbers_rows(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "k int, s string")
    cells = corpus.unpivot(df, 9, ["k"])
    assert {(r["rowid"], r["term"]) for r in cells.where("colid = 0").collect()} == {(i, str(i)) for i in range(50)}


def test_entries_are_validated(spark):
    c = table_cells(spark, [("a", "1"), ("b", "2")]).withColumn("tokenized", F.col("term"))
    assert search.query_tables(c, [("a", "1"), ("b", "2")], 2).count() == 1
    for wrong in (lambda: search.query_tables(c, [("a", "1")], 2), lambda: search.query_tables(c, [("a", "1")], 0), lambda: search.similar_find_tables(c, ["a"], ["1", "2"], 1)):
        with pytest.raises(ValueError):
            wrong()


def test_seeded_input_keeps_n_values(spark):
    rows = spark.createDataFrame([(i, f"k{i}", f"v{i}") for i in range(30)], "rowid int, k string, v string")
    one, two = (sorted(r["k"] for r in evaluate.make_input(rows, 5, seed).where("v is not null").collect()) for seed in (1, 2))
    assert len(one) == len(two) == 5 and one != two


def test_loop_finds_more_by_what_it_found(spark):
    """Table 1 holds the examples and two more keys; table 2 only these two and a third: it is found by the answers."""
    t = lambda i, rows: [(i, c, r, v, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    rows = t(1, [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]) + t(2, [("c", "3"), ("d", "4"), ("e", "5"), ("a", "1"), ("b", "2")][:3] + [("a", "1"), ("b", "2")]) + t(3, [("x", "1"), ("y", "2")])
    cells = spark.createDataFrame(rows, "tableid long, colid int, rowid int, term string, tokenized string")
    fixed = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0)], "k string, v string, score double")
    keys = spark.createDataFrame([(k,) for k in "abcde"], "k string")
    of = lambda a: a.select("mid").distinct().select("mid", F.lit(0.5).alias("prior"), F.lit(0.5).alias("schema"))
    r = em.induce(cells, keys, fixed, of, 2, most=30)
    assert {(x["k"], x["v"]) for x in r.examples.collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")}
    wrong = spark.createDataFrame(t(4, [("a", "1"), ("b", "9"), ("c", "8"), ("q", "2"), ("b", "7"), ("b", "6"), ("b", "5"), ("a", "4")]), cells.schema)
    assert em.induce(wrong, keys, fixed, of, 2, most=2).evidence.count() == 0


def test_join_graph_of_long_lists(spark):
    sets = {t: {"all"} | {f"h{t % 3}"} | ({"few"} if t in (7, 8) else set()) for t in range(60)} | {100: {"rare"}, 101: {"rare"}, 102: {"own"}}
    rows = [("header", w, t) for t, ws in sets.items() for w in ws] * 2
    lists = graph.postings(spark.createDataFrame(rows, "field string, tok string, tableid long"))
    got = [tuple(x) for x in graph.join_graph(lists).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert graph.join_graph(lists.limit(0)).count() == 0


def test_empty_tables_give_empty_results(spark, tmp_path):
    c = spark.createDataFrame([], "tableid long, colid int, rowid int, term string, tokenized string")
    k = spark.createDataFrame([("a",), (None,)], "k string")
    e = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0)], "k string, v string, score double")
    of = lambda a: a.select("mid").distinct().select("mid", F.lit(0.5).alias("prior"), F.lit(0.5).alias("schema"))
    assert search.find_tables(c, ["a"], ["1"], 1).count() == 0
    assert {(r["k"], r["v"]) for r in em.induce(c, k, e, of, 2, most=2).examples.collect()} == {("a", "1"), ("b", "2")}
    assert {r["v"] for r in indirect.transform(c, k, e, of).collect()} == {"1", None}
    assert em.latent_truth(spark.createDataFrame([], "mid string, k string, v string")).count() == 0
    assert fd.cell_dependencies(c).count() == 0
    assert corpus.detect_header(c).count() == 0 and corpus.union_tables(c, spark.createDataFrame([], "tableid long, unionid long")).count() == 0
    assert lookup.learn(c, [(["x"], "y")]) is None
    assert graph.join_classes(graph.postings(spark.createDataFrame([], "field string, tok string, tableid long"))).count() == 0
    (tmp_path / "dump").mkdir()
    spark.createDataFrame([("no table",), ("{}",)], "value string").coalesce(1).write.text(str(tmp_path / "d"))
    r = corpus.ingest(corpus.read_dump(spark, str(tmp_path / "d")))
    assert (r.tables.count(), r.columns.count(), r.cells.count()) == (0, 0, 0)


def test_header_columns_are_turned_and_headers_taken_off(spark):
    raw = spark.createDataFrame([
        (1, "f", [["town", "Rom", "Oslo"], ["name", "Anna", "Bert"]], True, None, None, "The t", None, ["a", None]),
        (2, "f", [["born", "died"], ["1990", "2000"], ["1991", "2001"]], False, "http://Host.test/x", None, None, None, None),
        (5, "f", [["a", "Anna", "Bert"], ["year", "1990", "1991"]], False, None, None, None, None, None),
        (3, "f", [["only", "one"]], False, None, None, None, None, None),
        (4, "f", [["", "1"], ["b", "x"], ["a", "y"]], True, None, "dom", None, None, []),
    ], "id long, file string, relation array<array<string>>, hasHeader boolean, url string, domain string, title string, pageTitle string, termSet array<string>")
    r = corpus.ingest(raw)
    cells = {(x["tableid"], x["colid"], x["rowid"]): x["term"] for x in r.cells.collect()}
    heads = {(x["tableid"], x["colid"]): x["header"] for x in r.columns.collect()}
    assert {k: v for k, v in cells.items() if k[0] == 1} == {(1, 0, 0): "Anna", (1, 0, 1): "Bert", (1, 1, 0): "Rom", (1, 1, 1): "Oslo"}
    assert {k: v for k, v in heads.items() if k[0] == 1} == {(1, 0): "name", (1, 1): "town"}
    # a first column of text beside rows of numbers is a header column: the table is turned
    assert {k: v for k, v in heads.items() if k[0] == 5} == {(5, 0): "a", (5, 1): "Anna", (5, 2): "Bert"}
    assert {k: v for k, v in cells.items() if k[0] == 5} == {(5, 0, 0): "year", (5, 1, 0): "1990", (5, 2, 0): "1991"}
    assert not any(k[0] == 3 for k in cells)
    assert {k: v for k, v in heads.items() if k[0] == 4} == {(4, 0): "a", (4, 1): "b", (4, 2): ""}
    t = {x["id"]: x for x in r.tables.collect()}
    assert t[2]["domain"] == "host.test" and t[4]["domain"] == "dom" and t[1]["title_tokenized"] == "t"
