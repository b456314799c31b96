"""Operators of the llm subpackage against brute force, on small tables with nulls, ties, repeats and odd values."""

import base64
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.llm import capping, distinctive, encoding, leakage, mojibake, set_join, term_counts, truncation

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CELLS = "tableid long, colid int, rowid int, term string, tokenized string, n int, rank int"


def random_cells(seed=1, n=1200):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = r.choice([1] * 6 + list(range(2, 30)))
        v = r.choice(["hot"] * 6 + [f"w{k}" for k in range(40)] + ["", None])
        rows.append((t, r.randrange(3), i, v and v.title(), v, 1, 2))
    return rows + rows[:30]


# set similarity join


def brute_pairs(sets, t, least):
    keys = sorted(k for k in sets if len(sets[k]) >= least)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("large", [1 << 14, 4])
def test_set_join(spark, monkeypatch, large):
    monkeypatch.setattr(set_join, "LARGE", large)
    r, rows = random.Random(3), []
    base = [f"v{i}" for i in range(60)]
    for k in range(60):
        s = r.sample(base, r.randrange(5, 14)) if k % 3 else [f"v{i}" for i in range(9)] + [f"v{i}" for i in r.sample(range(9, 60), k % 4)]
        rows += [(k // 4, k % 4, v) for v in s] * 2 + [(k // 4, k % 4, None), (k // 4, k % 4, "")]
    sets = defaultdict(set)
    for a, b, v in rows:
        if v:
            sets[a, b].add(v)
    df = spark.createDataFrame(rows, "a long, b int, v string").select(F.struct("a", "b").alias("r"), "v")
    got = [(tuple(x["a"]), tuple(x["b"])) for x in set_join.pairs(df, 0.6, 8).collect()]
    want = brute_pairs(sets, 0.6, 8)
    assert len(got) == len(set(got)) and set(got) == want and want
    m = set_join.membership(df, 0.6, 8).collect()
    assert {tuple(x["r"]) for x in m} == {k for k in sets if len(sets[k]) >= 8}
    assert set_join.pairs(df.limit(0), 0.6, 8).count() == 0


# capping


def test_capping(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        domain = r.choice(["Big.example.", "www.big.example", " BIG.example ", None, "", "small.test", "www.small.test"])
        url = r.choice(["http://u:p@www.big.example:80/x", "https://other.test", "nonsense", None])
        rows.append((r.randrange(1 << 40), domain, url, r.choice([None, -1, 5, 5, 90]), r.choice([None, 0.5, 0.5, 0.9]), "x"))
    rows += rows[:40]
    df = spark.createDataFrame(rows, "id long, domain string, url string, openrank int, confidence double, over string")

    def host(d, u):
        if d is None or not d.strip():
            d = (u or "").split("://")[1].split("/")[0].split("@")[-1].split(":")[0] if u and "://" in u else ""
        d = d.strip().lower().rstrip(".")
        return d[4:] if d.startswith("www.") else d

    groups = defaultdict(dict)
    for i, d, u, o, c, _ in rows:
        groups[host(d, u)][i] = (-max(o or 0, 0), -(c or 0), i)
    cap = math.ceil(0.02 * len({x[0] for x in rows}))
    want = {i for g in groups.values() for i in sorted(g, key=g.get)[cap:]}
    assert {x["id"] for x in capping.dropped(df, share=0.02).collect()} == want
    assert capping.kept(df, share=0.02).select("id").distinct().count() == len({x[0] for x in rows}) - len(want)
    assert capping.dropped(df.limit(0), share=0.02).count() == 0


# term counts


def brute_counts(rows):
    occ, rec = Counter(), defaultdict(set)
    for t, _, _, term, tok, *_ in set(rows):
        for f, v in (("term", term), ("tokenized", tok)):
            if v is not None:
                occ[f, v] += 1
                rec[f, v].add(t)
    return {(f, v, n, len(rec[f, v])) for (f, v), n in occ.items()}


_FIVE = "tableid long, colid int, rowid int, term string, tokenized string"


@pytest.mark.parametrize("per_bucket", [4_000_000, 5])
def test_deltas_equal_a_recount(spark, tmp_path, monkeypatch, per_bucket):
    monkeypatch.setattr(term_counts, "PER_BUCKET", per_bucket)
    rows = [x[:5] for x in random_cells()]
    old, changed = rows[:700], rows[650:]
    frame = lambda x: spark.createDataFrame(x, _FIVE)
    at = f"file://{tmp_path}/s"
    state = term_counts.TermCounts(spark, at, buckets=4)
    state.apply(added=frame(old))
    assert {tuple(x) for x in state.terms().collect()} == brute_counts(old)
    # cells that come and go in records whose other cells stay
    new = sorted(set(changed) - set(old), key=str)
    gone = sorted(set(old[:120]), key=str)
    state = term_counts.TermCounts(spark, at)
    added, removed = term_counts.whole(frame(old), frame(new), frame(gone))
    state.apply(added=added, removed=removed)
    now = (set(old) | set(new)) - set(gone)
    assert {tuple(x) for x in state.terms().collect()} == brute_counts(now)
    state.apply(added=frame([]))
    assert {tuple(x) for x in term_counts.TermCounts(spark, at).terms().collect()} == brute_counts(now)
    with pytest.raises(ValueError):
        state.apply(removed=frame([(1, 1, 1, "never", "there")]))
    again = term_counts.TermCounts(spark, at)
    assert {tuple(x) for x in again.terms().collect()} == brute_counts(now)
    assert (again.buckets > 4) == (per_bucket == 5)
    # two snapshots: records that differ are replaced, the others are not read
    later = {x for x in now if x[0] != 3} | {(50, 0, 0, "new", "new"), (1, 0, 0, None, "x")}
    added, removed = term_counts.changes(frame(sorted(now, key=str)), frame(sorted(later, key=str)))
    assert {x["tableid"] for x in added.collect()} == {1, 50} and {x["tableid"] for x in removed.collect()} == {1, 3}
    again.apply(added=added, removed=removed)
    assert {tuple(x) for x in again.terms().collect()} == brute_counts(later)
    again.apply(removed=frame(sorted(later, key=str)))
    assert again.terms().count() == 0


def test_counts_of_nothing_and_of_one_hot_record(spark, tmp_path):
    state = term_counts.TermCounts(spark, f"file://{tmp_path}/e", buckets=2)
    state.apply(added=spark.createDataFrame([], _FIVE))
    assert state.terms().count() == 0
    rows = [(7, 0, i, f"v{i % 5}", "t" if i % 2 else None) for i in range(500)] * 2 + [(None, 0, 0, "lost", "lost")]
    state.apply(added=spark.createDataFrame(rows, _FIVE))
    assert {tuple(x) for x in state.terms().collect()} == {("term", f"v{i}", 100, 1) for i in range(5)} | {("tokenized", "t", 250, 1)}


def test_marks(spark, tmp_path):
    rows = [(t, 0, 0, "all", "all") for t in range(40)] + [(1, 1, 1, "one", "one"), (1, 1, 1, "one", "one"), (2, 1, 1, None, "x")]
    state = term_counts.TermCounts(spark, f"file://{tmp_path}/m", buckets=2)
    state.apply(added=spark.createDataFrame(rows, "tableid long, colid int, rowid int, term string, tokenized string"))
    stored = spark.createDataFrame([("all", 40), ("one", 2), ("x", None), ("absent", 0), ("gone", 3), (None, 1)], "term string, number_occurence long")
    assert {tuple(x) for x in term_counts.marks(state.terms(), 40, stored).collect()} == {("one", "rare"), ("all", "common"), ("one", "drift"), ("gone", "drift")}


# distinctiveness


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_distinctiveness(spark, monkeypatch, block):
    monkeypatch.setattr(distinctive, "BLOCK", block)
    from tabweave.plans.common import written

    rows = random_cells(7)
    df = spark.createDataFrame(rows, CELLS)
    tf, near, columns = Counter(), defaultdict(set), defaultdict(list)
    for t, c, i, _, v, *_ in sorted(set(rows), key=lambda x: x[2]):
        if v:
            tf[t, v] += 1
            columns[t, c].append(v)
            near[t, v]
    got = {(x["tableid"], x["tokenized"]): x["weight"] for x in distinctive.frequencies(df).collect()}
    assert got == tf
    scored = distinctive.scores(written(distinctive.frequencies(df), "t"), 29)
    held = Counter(v for _, v in tf)
    want = {k: round(n * math.log(29 / held[k[1]]), 6) for k, n in tf.items()}
    assert {(x["tableid"], x["tokenized"]): x["score"] for x in scored.collect()} == pytest.approx(want)
    assert max(Counter(x["tableid"] for x in distinctive.best(scored).collect()).values()) == 3
    if block > len(rows):
        for (t, _), vs in columns.items():
            for i, a in enumerate(vs):
                for b in vs[i + 1 : i + 4]:
                    if a != b:
                        near[t, a].add(b)
                        near[t, b].add(a)
        assert {(x["tableid"], x["tokenized"]): x["weight"] for x in distinctive.degrees(df).collect()} == {k: len(x) for k, x in near.items()}
    assert distinctive.degrees(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 15, 64, 8])
def test_degrees_across_blocks_with_blank_cells(spark, monkeypatch, block):
    monkeypatch.setattr(distinctive, "BLOCK", block)
    r = random.Random(9)
    rows = [(t, c, i, v, v, 1, 2) for t in (1, 2) for c in (0, 1) for i in range(300) if i % 11 for v in [r.choice(["", "", None, *(f"w{k}" for k in range(90))] if i % 64 > 6 else ["", None, "w1"])]]
    columns, near = defaultdict(list), defaultdict(set)
    for t, c, _, _, v, *_ in rows:
        if v:
            columns[t, c].append(v)
            near[t, v]
    for (t, _), vs in columns.items():
        for i, a in enumerate(vs):
            for b in vs[i + 1 : i + 4]:
                if a != b:
                    near[t, a].add(b)
                    near[t, b].add(a)
    got = {(x["tableid"], x["tokenized"]): x["weight"] for x in distinctive.degrees(spark.createDataFrame(rows, CELLS)).collect()}
    assert got == {k: len(x) for k, x in near.items()}


# encoding


@pytest.fixture(scope="module")
def vocabulary():
    return encoding.Vocabulary(VOCABULARY)


@pytest.fixture(scope="module")
def judge():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_perfect_and_minimal(vocabulary):
    found = vocabulary.hash.find_all(vocabulary.tokens)
    assert (found == np.arange(len(found))).all()
    assert sorted(vocabulary.hash.slot_key.tolist()) == list(range(len(found)))
    assert [vocabulary.hash.find(t) for t in vocabulary.tokens[:50]] == list(range(50))
    assert vocabulary.rank(b"no such token at all") == -1


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_encoding_of_any_text(vocabulary, judge, text):
    pieces = __import__("regex").findall(encoding.PATTERN, text)
    vocabulary.resolve(set(pieces))
    assert [i for p in pieces for i in vocabulary.memo[p]] == judge.encode_ordinary(text)


def test_encode(spark, judge):
    texts = [None, "", " ", "<|endoftext|> x", "Nehepe\r\n\n  Größe 東京 🙂", "a" * 30_000, "wort " * 5000, "x" * 50 + "ß" * 999]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(1, "", 5)], "doc_id long, text string, ids int")
    got = [(x["doc_id"], list(x["ids"])) for x in encoding.encode(df, VOCABULARY).collect()]
    assert sorted(got) == sorted([(i, judge.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(1, [])])
    assert encoding.encode(df.limit(0), VOCABULARY).count() == 0


# leakage


def brute_leaks(docs, items):
    out = set()
    for i, a in ((i, leakage.words(t)) for i, t in items):
        for k, b in ((k, leakage.words(t)) for k, t in docs):
            for off in range(-len(b) + 1, len(a)):
                eq = [a[x] == b[x - off] for x in range(max(0, off), min(len(a), len(b) + off))]
                for s in range(len(eq)):
                    bad = 0
                    for e in range(s, len(eq)):
                        bad += not eq[e]
                        if e - s + 1 >= 22 and eq[s] and eq[e] and bad * 8 <= e - s + 1:
                            out.add((k, i))
    return out


@pytest.mark.parametrize("shard, cells", [(300_000, 4_000_000), (120, 4_000_000), (300_000, 50)])
def test_leaks(spark, monkeypatch, shard, cells):
    monkeypatch.setattr(leakage, "SHARD", shard)
    monkeypatch.setattr(leakage, "CELLS", cells)
    r = random.Random(11)
    vocab = [f"word{i}" for i in range(80)]
    items = [(900 + i, " ".join(r.choices(vocab, k=r.choice([10, 30, 50])))) for i in range(8)] + [(999, None)]
    docs = [(0, None), (1, ""), (2, "   ")]
    for k in range(3, 60):
        filler = lambda n: r.choices(vocab + ["other"], k=n)
        src = items[r.randrange(8)][1].split()
        run = src[r.randrange(5) :][: r.randrange(16, 40)]
        for _ in range(r.randrange(5)):
            run[r.randrange(len(run))] = "changed"
        docs.append((k, " ".join([*filler(r.randrange(20)), "<b>" + run[0].upper() + "</b>,", *run[1:], "\n>", *filler(r.randrange(90))])))
    docs.append((60, " ".join([*r.choices(vocab, k=400), *max((t for _, t in items if t), key=len).split()])))
    docs += docs[5:9]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leakage.leaks(d, i).collect()}
    assert got == brute_leaks(docs, items) and got
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0
    assert leakage.clean(d, leakage.leaks(d, i)).where("doc_id = 60").count() == 0


@settings(max_examples=60, deadline=None)
@given(text=st.lists(st.integers(1, 3), max_size=40), item=st.lists(st.integers(1, 3), min_size=1, max_size=20))
def test_suffix_order_and_places(text, item):
    t, q = np.array([*text, 0], np.int64), np.array([*item, -2], np.int64)
    order = leakage.suffix_array(t)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    at = np.arange(len(item))
    want = [sum(t[p:].tolist() < q[a:].tolist() for p in range(len(t))) for a in at]
    assert leakage.places(t, order, q, at).tolist() == want


def test_longest_match_and_its_place(spark, monkeypatch):
    r = random.Random(3)
    item = [f"w{r.randrange(500)}" for _ in range(60)]
    passage = item[10:50]
    passage[25] = "changed"
    docs = [(1, " ".join(["x"] * 7 + passage + ["y"] * 30 + item[:12])), (2, " ".join(["z"] * 300 + item[5:40]))]
    for shard in (300_000, 40):
        monkeypatch.setattr(leakage, "SHARD", shard)
        got = {x["doc_id"]: x for x in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
        assert (got[1]["n_words"], got[1]["n_replaced"], got[1]["n_verbatim"], got[1]["doc_word"], got[1]["item_word"]) == (40, 1, 25, 7, 10)
        assert (got[2]["n_words"], got[2]["n_verbatim"], got[2]["doc_word"], got[2]["item_word"]) == (35, 35, 300, 5)


# wrong decoding


@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", ["Für Straße gültige Größe", "répétée où été", "Później źródło żółta", "после года записей", "the editor’s “total”"])
def test_round_trip(codec, text):
    table = {b: c for c, b in mojibake._MAPS[codec].items()}
    wrong = "".join(chr(b) if b < 128 else chr(table[chr(b)]) for b in text.encode())
    got, damaged, lost = mojibake.restore(f"Some words. {wrong} and more.")
    assert damaged and not lost and text in got


@pytest.mark.parametrize("times", [2, 3, 4])
@pytest.mark.parametrize("text", ["редкая ячейка пишущая слова", "the editor’s “total”", "Größe répétée"])
def test_damage_on_damage(text, times):
    table = {b: c for c, b in mojibake._MAPS["cp1252"].items()}
    wrong = text
    for _ in range(times):
        wrong = "".join(chr(b) if b < 128 else chr(table[chr(b)]) for b in wrong.encode())
    assert mojibake.restore(f"Some words. {wrong} and more.") == (f"Some words. {text} and more.", True, False)


def test_whole_texts_are_left_alone():
    for t in ("", None, "plain", "SITUAÇÃO DE SÃO", "показывает значений школа", "«été» – l’école “Österreich”", "Größe ß Ähnlichkeit", "東海表 🙂 αβγ", 'A cell such as "BrÃ¼cke" is a sign.', "shows “Ã©” and “â€™” here"):
        got, damaged, lost = mojibake.restore(t)
        assert got == (t or "") and not damaged and not lost
    assert mojibake.restore("Gr��e")[2]


def test_cases_and_words(spark):
    good = [f"Die Größe für Brücke {i} ist gültig – “ja {i}”" for i in range(60)]
    docs = [(i, t) for i, t in enumerate(good)] + [(100, "Die Gr÷▀e fⁿr Brⁿcke"), (101, None), (102, ""), (103, "GrÃ¶ÃŸe"), (104, "Gr�sse"), (100, "Die Gr÷▀e fⁿr Brⁿcke")]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, lost int")
    assert sorted(x["doc_id"] for x in mojibake.cases(df).collect()) == [100, 103, 104]
    fixed = {x["doc_id"]: x["restored"] for x in mojibake.restored(df).collect()}
    assert fixed[103] == "Größe" and fixed[100] == "Die Größe für Brücke"
    assert mojibake.cases(df.limit(0)).count() == 0


# truncation

TABLES = "id long, title string, context string, pagetitle string, source int, content string, bare string"


def test_limits_are_found(spark):
    r = random.Random(2)
    rows = [("f", 1, "chars", n, 20 + r.randrange(9)) for n in range(10, 90)] + [("f", 2, "chars", n, (500 if n == 40 else 20 + r.randrange(9)) if n <= 40 else 0) for n in range(10, 60)]
    found = truncation.limits(spark.createDataFrame([x for x in rows if x[4]], "field string, source int, unit string, len int, n long")).collect()
    assert [(x["source"], x["len"]) for x in found] == [(2, 40)]


def test_truncated(spark):
    r = random.Random(4)
    nouns, names = ["table", "column", "ledger", "archive", "season", "drawer"], ["Vika", "Moleras", "Hitama", "Sonabel", "Defoba"]
    rows, cut = [], set()
    for i in range(600):
        title = f"All {r.choice(nouns)} records of {r.choice(names)} {r.choice(names)} with {r.choice(nouns)} and {r.choice(nouns)} since {r.randrange(1950, 2020)}"
        context = " ".join(f"The {r.choice(nouns)} of {r.choice(names)} {i} was {r.choice(['sorted', 'linked', 'counted'])} in {1900 + k}." for k in range(r.randrange(2, 9)))
        src = 1 + i % 2
        if src == 2:
            if len(title) > 45:
                title = title[:45]
                cut.add(("title", i))
            if len(context) > 200:
                context = context[:200]
                if not context.endswith("."):
                    cut.add(("context", i))
        rows.append((i, title, context, None, src, "{" if i % 5 else None, "x"))
    rows += rows[:20] + [(1000, None, " ", None, None, None, None), (1001, "", None, "", 1, '{"tuples":[{"cells":[{"value":"Levabizes"},{"value":"Mini*"},{"value":7}]}]}', "")]
    # complete cells of one to nine words, cut at 40 in odd tables
    cells = [(i, 0, k, " ".join(r.choices(nouns, k=r.randrange(1, 10) if k % 2 else 9))[: 40 if i % 2 else 100], "t", 1, 1) for i in range(0, 600, 3) for k in range(6)]
    cells += [(1001, 0, 0, "Levab", "t", 1, 1), (1001, 1, 0, "Mini", "t", 1, 1), (1001, 2, 0, "7", "t", 1, 1)]
    got = truncation.truncated(spark.createDataFrame(rows, TABLES), spark.createDataFrame(cells + cells[:50], CELLS)).collect()
    whole = {(x["field"], x["tableid"]) for x in got if x["field"] != "term"}
    assert len(whole & cut) >= 0.98 * len(cut) and len(whole - cut) <= 0.02 * len(cut)
    terms = {(x["tableid"], x["colid"], x["rowid"]) for x in got if x["field"] == "term"}
    want = {x[:3] for x in cells if x[0] % 2 and len(x[3]) == 40} | {(1001, 0, 0)}
    assert terms == want and len(got) == len(set(got))


def test_cells_broken_off_in_a_word(spark):
    r = random.Random(6)
    nouns = ["ledger", "vineyard", "turbine", "catalogue", "dossier", "harbor", "tariff", "voucher"]
    texts = [" ".join(r.choices(nouns, k=5)) for _ in range(300)] + ["Grade H"] * 40 + ["No", "no"] * 20
    cut = {3: "ledger turbine cata", 77: "VINEYARD HARB", 150: "dossier vouche", 220: "tariff catalogu"}
    cells = [(i, 0, 0, cut.get(i, x), "t", 1, 1) for i, x in enumerate(texts)] + [(900, 0, 0, None, None, 1, 1), (901, 0, 0, " ", "", 1, 1)]
    got = {x["tableid"] for x in truncation.broken_cells(spark.createDataFrame(cells + cells[:9], CELLS)).collect()}
    assert got == set(cut)
    assert truncation.broken_cells(spark.createDataFrame([], CELLS)).count() == 0


def test_titles_broken_off_in_a_word_of_a_fitting_pattern(spark):
    r = random.Random(8)
    nouns = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(5)) for _ in range(100)] + ["table", "tablets"]
    titles = [f"{r.choice(nouns).title()} of the {r.choice(nouns)} and {nouns[i % 102]}" for i in range(1200)]
    cut = {5, 120, 333, 700, 908}
    titles = [t[: -r.randrange(2, 6)] if i in cut else t for i, t in enumerate(titles)]
    rows = [(i, t, None, None, 1, None, "x") for i, t in enumerate(titles)]
    got = truncation.truncated(spark.createDataFrame(rows, TABLES), spark.createDataFrame([], CELLS)).collect()
    assert {(x["field"], x["tableid"]) for x in got} == {("title", i) for i in cut}


def test_growing_tables_are_not_broadcast(spark, tmp_path):
    content = '{"tuples":[{"cells":[{"value":"Levabizes"},{"value":"Mini*"},{"value":7}]}]}'
    spark.createDataFrame([(i, content) for i in range(40)], "id long, content string").write.parquet(f"{tmp_path}/tables")
    cells = [(i, k, 0, x, "t", 1, 1) for i in range(40) for k, x in enumerate(("Levabizes" if i % 8 else "Levab", "Mini", "7"))] + [(90, 0, 0, "dossier ledg", "t", 1, 1)] + [(91, 0, k, "ledger dossier ledger", "t", 1, 1) for k in range(20)]
    spark.createDataFrame(cells, CELLS).write.parquet(f"{tmp_path}/cells")
    spark.createDataFrame([("context", "ledger", 3, 4), ("title", "ledger", 1, 1)], "field string, w string, n_inner long, n_last long").write.parquet(f"{tmp_path}/words")
    tables, cells, words = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("tables", "cells", "words"))

    def rows(df, kind):
        got = sorted(map(tuple, df.collect()))
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if f", {kind}" in x]
        assert any("SortMergeJoin" in x for x in joins) and not any("Broadcast" in x for x in joins)
        return got

    assert rows(truncation.continued(tables, cells), "Inner") == [(i, 0, 0) for i in range(0, 40, 8)]
    assert (90, 0, 0) in rows(truncation.broken_cells(cells), "Inner")
    texts = spark.createDataFrame([("context", i, x, False) for i, x in enumerate(("one, ledger", "one, ledge"))], "field string, tableid long, bare string, ellipsis boolean")
    at_limit = spark.createDataFrame([], "field string, tableid long, limit boolean")
    assert rows(truncation._contexts(texts, at_limit, words), "LeftOuter") == [("context", 1, "ending")]


def test_truncated_of_nothing(spark):
    assert truncation.truncated(spark.createDataFrame([], TABLES), spark.createDataFrame([], CELLS)).count() == 0


def test_registered():
    from tabweave.llm import queries

    assert {f"p{n}_found" for n in (2, 4, 5, 6, 7, 9, 10)} | {"p8_ids"} <= set(queries.QUERIES)
    assert set(queries.SQL) <= set(queries.QUERIES)
