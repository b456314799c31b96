"""String programs by example: a small language, searched on the examples in the driver, compiled to one column expression.

A program is a sequence of parts: a constant, or a piece of an input: the whole input, the i-th run of a character class
(counted from either end), or a slice between two positions (each counted from either end); a piece may change its case or
its zero padding. The search walks the outputs of all examples at once: a state is how much of each output has been
written, a part leads on if its values stand there in every example, and the cheapest way to the ends of all outputs is the
program (constants cost by their length, so that copied text is preferred). It looks at up to `budget` states; a program
has no other bound on its parts, constants or runs.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = {"word": r"[A-Za-z]+", "digits": r"[0-9]+", "token": r"[A-Za-z0-9]+", "field": r"[^\s]+", "part": r"[^,;:|/]+"}
CASES = {"same": lambda s: s, "upper": str.upper, "lower": str.lower, "title": lambda s: s[:1].upper() + s[1:].lower(), "first": lambda s: s[:1], "strip0": lambda s: s.lstrip("0") or "0", "pad2": lambda s: s.rjust(2, "0")}


def _place(at: int, n: int) -> int:
    """A position in a text of n characters: 0, 1, .. from the left, -1 (the end), -2, .. from the right."""
    return at if at >= 0 else n + 1 + at


@dataclass(frozen=True)
class Part:
    text: str | None = None
    source: int = 0
    kind: str = "all"
    at: int = 0
    case: str = "same"
    end: int = 0

    def run(self, inputs: list[str]) -> str | None:
        if self.text is not None:
            return self.text
        s = inputs[self.source]
        if self.kind == "slice":
            a, b = _place(self.at, len(s)), _place(self.end, len(s))
            s = s[a:b] if 0 <= a < b <= len(s) else ""
        elif self.kind != "all":
            found = re.findall(CLASSES[self.kind], s)
            if not -len(found) <= self.at < len(found):
                return None
            s = found[self.at].strip()
        return CASES[self.case](s) if s else None

    def column(self, inputs: list[Column]) -> Column:
        if self.text is not None:
            return F.lit(self.text)
        c = inputs[self.source]
        if self.kind == "slice":
            a, b = ((F.lit(x) if x >= 0 else F.length(c) + (1 + x)) for x in (self.at, self.end))
            c = F.when((a >= 0) & (a < b) & (b <= F.length(c)), F.substr(c, a + 1, b - a))
        elif self.kind != "all":
            runs = F.regexp_extract_all(c, F.lit(CLASSES[self.kind]), F.lit(0))
            c = F.trim(F.try_element_at(runs, F.lit(self.at + 1 if self.at >= 0 else self.at)))
        c = F.when(c != "", c)
        return {"same": c, "upper": F.upper(c), "lower": F.lower(c), "title": F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c)))), "first": F.substring(c, 1, 1), "strip0": F.when(F.ltrim(c, F.lit("0")) == "", "0").otherwise(F.ltrim(c, F.lit("0"))), "pad2": F.when(F.length(c) >= 2, c).otherwise(F.lpad(c, 2, "0"))}[self.case]

    @property
    def cost(self) -> int:
        if self.text is not None:
            return 2 + 3 * len(self.text)
        return 1 + (self.case != "same") + (self.at < 0) + 6 * (self.kind == "slice") + (self.kind == "slice" and self.end < 0)


def _parts(examples: list[tuple[list[str], str]]) -> dict[tuple[str, ...], Part]:
    """values in all examples -> the cheapest part that has them; only values that stand in the outputs."""
    inputs, targets = [x for x, _ in examples], [y for _, y in examples]
    out: dict[tuple[str, ...], Part] = {}

    def offer(p: Part) -> None:
        values = []
        for x, y in zip(inputs, targets):
            v = p.run(x)
            if not v or v not in y:
                return
            values.append(v)
        old = out.get(tuple(values))
        if old is None or p.cost < old.cost:
            out[tuple(values)] = p

    for i, s in enumerate(inputs[0]):
        for kind, rule in (("all", ""), *CLASSES.items()):
            n = 1 if kind == "all" else len(re.findall(rule, s))
            for at in ((0,) if kind == "all" else (*range(n), *range(-n, 0))):
                for case in CASES:
                    offer(Part(None, i, kind, at, case))
        n = len(s)
        for a in range(n):
            for b in range(a + 1, n + 1):
                if any(f(s[a:b]) in targets[0] for f in (str, str.upper, str.lower)):
                    for at in (a, a - n - 1):
                        for end in (b, b - n - 1):
                            for case in ("same", "upper", "lower"):
                                offer(Part(None, i, "slice", at, case, end))
    return out


def learn(examples: list[tuple[list[str], str]], budget: int = 200_000) -> list[Part] | None:
    """The cheapest program that gives the output of all examples, or None."""
    if not examples or not all(y for _, y in examples):
        return None
    targets = [y for _, y in examples]
    pieces = list(_parts(examples).items())
    goal = tuple(map(len, targets))
    start = tuple(0 for _ in targets)
    best: dict[tuple[int, ...], int] = {start: 0}
    came: dict[tuple[int, ...], tuple[tuple[int, ...], Part]] = {}
    queue: list[tuple[int, int, tuple[int, ...]]] = [(0, 0, start)]
    while queue:
        cost, n, at = heapq.heappop(queue)
        if at == goal:
            parts: list[Part] = []
            while at != start:
                at, p = came[at]
                parts.append(p)
            return parts[::-1]
        if cost > best[at] or len(best) > budget:
            continue
        common = commonprefix([y[i:] for y, i in zip(targets, at)])
        steps = [(v, p) for v, p in pieces if all(y.startswith(x, i) for y, x, i in zip(targets, v, at))]
        steps += [((common[:k],) * len(targets), Part(common[:k])) for k in range(1, len(common) + 1)]
        for v, p in steps:
            to = tuple(i + len(x) for i, x in zip(at, v))
            new = cost + p.cost
            if new < best.get(to, 1 << 60):
                best[to], came[to] = new, (at, p)
                heapq.heappush(queue, (new, n + 1, to))
    return None


def score(parts: list[Part]) -> int:
    """How much of a program is taken from its inputs: parts that copy, less the characters of its constants."""
    return 10 * sum(p.text is None for p in parts) - sum(len(p.text) for p in parts if p.text is not None)


def run(parts: list[Part], inputs: list[str]) -> str | None:
    values = [p.run(inputs) for p in parts]
    return None if any(v is None for v in values) else "".join(values)


def compile_program(parts: list[Part], inputs: list[Column]) -> Column:
    """The program as one expression; null where a part finds nothing."""
    return reduce(lambda a, b: F.concat(a, b), (p.column(inputs) for p in parts))
