"""Texts decoded with the wrong character encoding: which ones, and their original text.

Multibyte damage. For each legacy encoding, every character that it can hold is mapped back to its byte, and the
byte-structure automaton of UTF-8 runs over these bytes. It finds the maximal well-formed multibyte spans; only those
spans are decoded, the rest of the text is left as it is. A span counts if it decodes to letters or marks that texts use
(REPERTOIRE), or to characters that are damage themselves and come to such letters in the end; damage on damage is undone
in further rounds, until none is left. The encoding whose spans restore most characters wins.

Single-byte damage (one legacy encoding read as another) has no multibyte structure. The same map back to bytes is
applied to each word with a non-ASCII character: its bytes are decoded by each other encoding of its family, and the
word counts as damaged if it is rare in the collection while what it decodes to is common there. A document needs two such words, a long one, or a
lone letter that is a mark misread. Word counts cover all
documents and are joined, not sent around.

U+FFFD marks text whose characters were lost; it can't be restored. A span that stands alone in quotation marks, in a
text that is otherwise whole, is a quotation of such characters and no case.

Defined cases: null, empty and ASCII texts are whole; texts are read whole, however long; repeated rows give one row per
document; a document without a key is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.plans.common import parallelism, written

#: Encodings in which UTF-8 bytes are commonly read by mistake.
MULTIBYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp852", "cp1251", "cp866", "koi8_r", "cp1250", "iso8859_2", "cp1254", "iso8859_15", "mac_cyrillic")
#: (read as, written in): single-byte encodings that are taken for one another.
SINGLE = tuple((a, b) for family in (("cp1252", "mac_roman", "cp437", "cp850"), ("cp1250", "iso8859_2", "cp852", "cp1252", "mac_latin2"), ("cp1254", "cp1252", "cp857"), ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1252", "mac_roman", "mac_cyrillic", "cp437")) for a in family for b in family if a != b)
CYRILLIC = ("cp1251", "cp866", "koi8_r", "mac_cyrillic")
LOST = "�"
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def _bytes_of(codec: str) -> dict[int, str]:
    """Character -> the byte it stands for in codec, as a character below U+0100; bytes without a character stand for
    the control character of the same number, as lenient decoders have it."""
    out = {b: chr(b) for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            out.setdefault(b, chr(b))
    return {c: b for c, b in out.items() if c >= 0x80}


_MAPS = {c: _bytes_of(c) for c in sorted({*MULTIBYTE, *(x for p in SINGLE for x in p)})}
#: Accepting paths of the UTF-8 automaton over bytes written as characters: no overlong forms, surrogates or ends beyond U+10FFFF.
_TAIL = "[\x80-\xbf]"
_SEQUENCE = f"(?:[\xc2-\xdf]{_TAIL}|\xe0[\xa0-\xbf]{_TAIL}|[\xe1-\xec\xee\xef]{_TAIL}{{2}}|\xed[\x80-\x9f]{_TAIL}|\xf0[\x90-\xbf]{_TAIL}{{2}}|[\xf1-\xf3]{_TAIL}{{3}}|\xf4[\x80-\x8f]{_TAIL}{{2}})"
_SPAN = re.compile(f"{_SEQUENCE}+")


def _hint(codec: str) -> re.Pattern:
    """A lead byte before a trail byte, in the characters of codec: a text without one has no span."""
    of = lambda a, b: "".join(re.escape(chr(c)) for c, x in _MAPS[codec].items() if a <= x <= b)
    return re.compile(f"[{of(chr(0xC2), chr(0xF4))}][{of(chr(0x80), chr(0xBF))}]")


_HINTS = {c: _hint(c) for c in MULTIBYTE}


def _used(c: str) -> bool:
    """REPERTOIRE: whether texts use the character."""
    o = ord(c)
    return 0xA0 <= o <= 0x17F or o in (0x218, 0x219, 0x21A, 0x21B, 0x1E9E) or 0x391 <= o <= 0x3C9 or 0x400 <= o <= 0x45F or o in (0x490, 0x491) or 0x5D0 <= o <= 0x5EA or 0x621 <= o <= 0x64A or 0x900 <= o <= 0x97F or 0xE00 <= o <= 0xE5B or 0x2010 <= o <= 0x203A or 0x20A0 <= o <= 0x20BF or o in (0x2116, 0x2122, 0x2190, 0x2192, 0x2248, 0x2260, 0x2264, 0x2265) or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0x1F300 <= o <= 0x1FAFF or o in (0xFEFF, 0x200B)


def _in_word(text: str, a: int, b: int, new: str) -> bool:
    """Whether a span may be a piece of an ordinary Cyrillic word: lead and trail bytes are letters in these encodings."""
    return "Ѐ" <= text[a - 1 : a] <= "џ" or "Ѐ" <= text[b : b + 1] <= "џ" or any(c > "џ" and not "‐" <= c <= "™" for c in new)


def _settles(new: str) -> bool:
    """Whether texts use all characters of new, or those they don't use lie in well-formed spans of one encoding that settle."""
    odd = {i for i, c in enumerate(new) if not _used(c)}
    if not odd:
        return True
    for codec in MULTIBYTE:
        if _HINTS[codec].search(new):
            raw = "".join([_MAPS[codec].get(ord(c), "Ā") for c in new])
            found = [s for s in _SPAN.finditer(raw) if odd & set(range(*s.span()))]
            if odd <= {i for s in found for i in range(*s.span())} and all(_settles(s.group().encode("latin-1").decode("utf-8")) for s in found):
                return True
    return False


def spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the maximal well-formed multibyte spans that decode to used characters, at once or in the end."""
    table, out = _MAPS[codec], []
    for m in _NON_ASCII.finditer(text):
        # characters that the encoding lacks become U+0100, which no path of the automaton accepts
        raw = "".join([table.get(ord(c), "Ā") for c in m.group()])
        for s in _SPAN.finditer(raw):
            new = s.group().encode("latin-1").decode("utf-8")
            if _settles(new) and not (codec in CYRILLIC and _in_word(text, m.start() + s.start(), m.start() + s.end(), new)):
                out.append((m.start() + s.start(), m.start() + s.end(), new))
    return out


def _weight(text: str, found: list[tuple[int, int, str]], codec: str) -> int:
    """Restored characters; 0 if they could as well be there by chance."""
    n = sum(len(x) for _, _, x in found)
    if not n:
        return 0
    if codec in CYRILLIC:
        return n if n >= 3 else 0
    if n == 1:
        a, b, x = found[0]
        beside = text[max(0, a - 1) : a] + text[b : b + 1]
        if not (x.isalpha() and any(c.isalpha() for c in beside) or x in "‘’“”–—…€•" or b - a >= 3):
            return 0
        if x.isalpha() and text[a:b].isupper() and beside.isupper():
            return 0
    return n


_QUOTES = {'"': '"', "“": "”“", "„": "“”", "«": "»", "'": "'", "‘": "’", "`": "`"}


def quoted(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] lies in a quotation of its own: one or two words between quotation marks."""
    for i in range(a - 1, max(-1, a - 31), -1):
        if text[i] in _QUOTES:
            if i and text[i - 1].isalnum():
                return False
            for j in range(b, min(len(text), b + 30)):
                if text[j] in _QUOTES[text[i]]:
                    return text.count(" ", i, j) <= 1 and "\n" not in text[i:j]
            return False
    return False


def restore(text: str | None) -> tuple[str, bool, bool]:
    """(text with its multibyte damage undone, whether there was damage outside quotations, whether some was lost)."""
    if not text or text.isascii():
        return text or "", False, False
    lost = any(not quoted(text, m.start(), m.end()) for m in re.finditer(LOST, text))
    damaged = False
    while True:  # each round makes the text shorter
        best, weight = [], 0
        for codec in MULTIBYTE:
            if not _HINTS[codec].search(text):
                continue
            found = [x for x in spans(text, codec) if not quoted(text, x[0], x[1])]
            w = _weight(text, found, codec)
            if w > weight:
                best, weight = found, w
        if not best:
            break
        damaged, parts, at = True, [], 0
        for a, b, new in best:
            parts += (text[at:a], new)
            at = b
        text = "".join([*parts, text[at:]])
    return text, damaged, lost


def readings(word: str) -> list[str]:
    """What the word may have been before it was read in another single-byte encoding of its family."""
    out = []
    for wrong, right in SINGLE:
        table = _MAPS[wrong]
        raw = []
        for c in word:
            b = c if c < "\x80" else table.get(ord(c))
            if b is None:
                break
            raw.append(b)
        else:
            try:
                new = "".join(raw).encode("latin-1").decode(right)
            except UnicodeDecodeError:
                continue
            if new != word and any(c >= "\x80" for c in new) and all(c.isalnum() or c in "‘’“”–€" or c < "\x80" for c in new):
                out.append(new)
    return sorted(set(out))


#: A word here is a run of ASCII letters and of any non-ASCII characters but spaces and format marks, with one of these at least.
#: It is looked for from its start only, and never given back: words of ASCII letters alone are passed over once.
_WORDS = r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7F\p{Z}\p{Cf}][^\x00-\x40\x5B-\x60\x7B-\x7F\p{Z}\p{Cf}]*+"
_EDGE = r"^[\x{201C}\x{201D}\x{201E}\x{AB}\x{BB}\x{2013}\x{2014}\x{2026}\x{A0}\x{BF}\x{A1}\x{2018}]+|[\x{201C}\x{201D}\x{201E}\x{AB}\x{BB}\x{2013}\x{2014}\x{2026}\x{A0}\x{2019}]+$"


def _words(documents: DataFrame) -> DataFrame:
    """(k, w): the words with a non-ASCII character of each document, each once: as they stand, without marks at their
    ends, and (for one mark or letter before ASCII letters) with the letters as "a", so that marks have counts too."""
    raw = F.array_distinct(F.regexp_extract_all("t", F.lit(_WORDS), F.lit(0)))
    bare = F.transform(raw, lambda x: F.regexp_replace(x, _EDGE, ""))
    shape = F.transform(F.filter(raw, lambda x: x.rlike(r"^[^\x00-\x7F][A-Za-z]+$")), lambda x: F.concat(F.substring(x, 1, 1), F.lit("a")))
    return documents.select("k", F.explode(F.array_distinct(F.concat(raw, bare, shape))).alias("w")).where("w <> ''")


def damaged_words(documents: DataFrame, least: int = 4, times: int = 20) -> tuple[DataFrame, DataFrame]:
    """documents (k, t). The words of all documents, and (w, original) of the words that are another word misread: the
    original is in at least `least` documents and `times` as many as the word."""
    words = written(_words(documents), "words")
    counts = words.groupBy("w").agg(F.count("*").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, n, o) for w, n in zip(f["w"], f["n"]) for o in readings(w)]
            yield pd.DataFrame(rows, columns=["w", "n", "original"])

    # the words are few in bytes but dear to read: an exchange of its own, which is neither dropped nor brought down to one task
    tried = counts.repartition(parallelism(documents.sparkSession), F.xxhash64("w")).mapInPandas(run, "w string, n long, original string")
    known = counts.select(F.col("w").alias("original"), F.col("n").alias("m"))
    best = tried.join(known, "original").where((F.col("m") >= least) & (F.col("m") >= times * F.col("n"))).groupBy("w").agg(F.max_by("original", F.struct("m", "original")).alias("original"))
    return words, best


def cases(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lost): the documents that were decoded wrongly, in whole or in part."""
    rows = documents.select(documents[key].cast("long").alias("k"), documents[text].cast("string").alias("t")).where(F.col("k").isNotNull() & F.col("t").rlike(r"[^\x00-\x7F]"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, lost) for k, t in zip(f["k"], f["t"]) for _, damaged, lost in (restore(t),) if damaged or lost]
            yield pd.DataFrame(out, columns=["doc_id", "lost"])

    multibyte = rows.mapInPandas(run, "doc_id long, lost boolean")
    words, damaged = damaged_words(rows)
    mark = (F.length("w") == 1) & F.col("original").isin(*"‘’“”–—€")
    single = words.join(damaged, "w").groupBy("k").agg(F.count("*").alias("n"), F.max(F.length("w")).alias("longest"), F.max(mark).alias("mark"))
    single = single.where("n >= 2 or longest >= 5 or mark").select(F.col("k").alias("doc_id"), F.lit(False).alias("lost"))
    return multibyte.unionByName(single).groupBy("doc_id").agg(F.max("lost").alias("lost"))


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored) of the documents whose text changes by restoring its damage."""
    rows = documents.select(documents[key].cast("long").alias("k"), documents[text].cast("string").alias("t")).where(F.col("k").isNotNull() & F.col("t").rlike(r"[^\x00-\x7F]"))
    words, damaged = damaged_words(rows)
    swaps = words.join(damaged, "w").groupBy("k").agg(F.array_sort(F.collect_list(F.struct((-F.length("w")).alias("l"), "w", "original"))).alias("swaps"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t, s in zip(f["k"], f["t"], f["swaps"]):
                new, _, _ = restore(t)
                for x in s if s is not None else ():
                    new = re.sub(rf"(?<![^\W\d_]){re.escape(x['w'])}(?![^\W\d_])", lambda m, o=x["original"]: o, new)
                if new != t:
                    out.append((k, new))
            yield pd.DataFrame(out, columns=["doc_id", "restored"])

    return rows.join(swaps, "k", "left").select("k", "t", "swaps").mapInPandas(run, "doc_id long, restored string").distinct()
