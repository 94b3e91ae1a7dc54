"""Layout markers: repair by grammars, region extraction by confidence, layout graphs and their edit distance, average precision.

Repairs insert (confidence 0) or delete markers, each counting as one operation. Flat grammars are one fold in the JVM; grammars with pages and
sections are one automaton, driven by a Grammar, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.edit import edits
from quirework.functions.text import ACT_PAIRS, LETTER_PAIRS, READ_PAIRS, class_of
from quirework.session import spread


def flat_repair(s: Column, pairs: dict[str, str] = LETTER_PAIRS) -> Column:
    """struct(text, ops): a region that is open when another begins is closed first; an end without its begin is deleted; a region open at the end is closed.

    A begin marker settles what stands up to the next one: its first own end closes it, every other end there is stray. So the text is cut before begin markers and each piece is mended alone."""
    begins, closings = "".join(pairs), "".join(pairs.values())
    ends = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    cut = f"(?s)({class_of(begins)}{class_of(begins, negated=True)}*|{class_of(begins, negated=True)}+)"

    def mended(x: Column) -> Column:
        own = F.coalesce(F.try_element_at(ends, F.substring(x, 1, 1)), F.lit(""))  # empty before the first begin marker
        at = F.when(own == "", 0).otherwise(F.position(own, x))
        closed = at > 0
        head = F.when(closed, F.substr(x, F.lit(1), at - 1)).otherwise(x)
        tail = F.when(closed, F.substr(x, at + 1)).otherwise(F.lit(""))
        text = F.concat(F.translate(head, closings, ""), own, F.translate(tail, closings, ""))
        strays = F.char_length(x) - F.char_length(F.translate(x, closings, "")) - closed.cast("int")
        return F.struct(text.alias("text"), (strays + ((own != "") & ~closed).cast("int")).alias("ops"))

    made = F.transform(F.regexp_extract_all(s, F.lit(cut), F.lit(1)), mended)
    return F.struct(F.array_join(F.transform(made, lambda m: m["text"]), "").alias("text"), F.aggregate(made, F.lit(0), lambda a, m: a + m["ops"]).alias("ops"))


@dataclass(frozen=True)
class Grammar:
    """Pages tile the text; sections lie in pages; `inside` regions only in sections, `outside` ones only out of them."""

    pairs: tuple[tuple[str, str], ...]
    page: str
    section: str
    inside: str
    outside: str = ""

    @property
    def ends(self) -> dict[str, str]:
        return dict(self.pairs)


READ = Grammar(tuple(READ_PAIRS.items()), "ⓟ", "ⓢ", "ⓐⓑ", "ⓝ")
ACTS = Grammar(tuple((k, v) for k, v in ACT_PAIRS.items()), "ⓟ", "ⓜ", "ⓝⓑⓘⓢ")
#: Letters have neither pages nor sections: all regions follow each other below the document.
LETTERS = Grammar(tuple(LETTER_PAIRS.items()), "", "", "", "".join(LETTER_PAIRS))


def _page_repair(text: str, page: str, end: str) -> list[tuple[str, bool]]:
    """Characters with whether they were inserted: every page is opened and closed, and nothing stands between pages."""
    out: list[tuple[str, bool]] = []
    for c in text:
        last = out[-1][0] if out else end
        if c == page:
            if out and last != end:
                out.append((end, True))
        elif last == end:
            out.append((page, True))
        out.append((c, False))
    if not out:
        out.append((page, True))
    if out[-1][0] != end:
        out.append((end, True))
    return out


def tree_repair(text: str, grammar: Grammar = READ) -> tuple[str, int, list[int]]:
    """The repaired text, the number of operations, and for each of its characters its place in the given text (-1: inserted, with confidence 0)."""
    ends = grammar.ends
    begin_of = {b: a for a, b in ends.items()}
    page_end, section_end = ends[grammar.page], ends[grammar.section]
    children = grammar.inside + grammar.outside
    out: list[str] = []
    at: list[int] = []
    ops = place = 0
    child: str | None = None
    in_section = False

    def add(c: str) -> None:
        nonlocal ops
        out.append(c)
        at.append(-1)
        ops += 1

    def close(section: bool) -> None:
        nonlocal child, in_section
        if child is not None:
            add(ends[child])
            child = None
        if section and in_section:
            add(section_end)
            in_section = False

    for c, inserted in _page_repair(text, grammar.page, page_end):
        own = -1 if inserted else place
        place += not inserted
        if c == page_end:
            close(True)
        elif c in begin_of and begin_of[c] in children:
            if child != begin_of[c]:
                ops += 1
                continue
            child = None
        elif c == section_end:
            if not in_section:
                ops += 1
                continue
            close(False)
            in_section = False
        elif c == grammar.section:
            close(True)
            in_section = True
        elif c in grammar.outside:
            close(True)
            child = c
        elif c in grammar.inside:
            close(False)
            if not in_section:
                add(grammar.section)
                in_section = True
            child = c
        out.append(c)
        at.append(own)
        ops += inserted
    return "".join(out), ops, at


def repaired(df: DataFrame, key: str, text: str, grammar: Grammar) -> DataFrame:
    """key, text, ops; null texts are treated as empty ones."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [tree_repair(t or "", grammar) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], [key, "text", "ops"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, text string, ops int")


# ---- graphs ------------------------------------------------------------------------------------------------------


def layout_graph(text: str, grammar: Grammar) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
    """Nodes (type, page) and edges of a text's regions: the document, pages below it, sections and outside regions below a page, inside regions below the last of these; every node also follows
    its elder sibling. Regions without the parent they need hang on the document."""
    nodes: list[tuple[str, int]] = [("document", 0)]
    edges: list[tuple[int, int]] = []
    levels: list[int | None] = [0, None, None, None]
    page = 0
    for c in text:
        if c == grammar.page:
            depth, page = 1, page + 1
        elif c == grammar.section or c in grammar.outside:
            depth = 2
        elif c in grammar.inside:
            depth = 3
        else:
            continue
        nodes.append((c, page))
        me = len(nodes) - 1
        parent = next(x for x in reversed(levels[:depth]) if x is not None)
        edges.append((parent, me))
        if levels[depth] is not None:
            edges.append((levels[depth], me))
        levels[depth] = me
        levels[depth + 1 :] = [None] * (3 - depth)
    return nodes, edges


def flat_graph_size(s: Column, begins: str = "".join(LETTER_PAIRS)) -> tuple[Column, Column]:
    """Nodes and edges of a star with a chain: n regions make n + 1 nodes and 2n - 1 edges (none: none)."""
    n = F.char_length(s) - F.char_length(F.translate(s, begins, ""))
    return n + 1, F.greatest(2 * n - 1, F.lit(0))


Graph = tuple[list[str], set[tuple[int, int]]]


def _mapping_cost(a: Graph, b: Graph, to: list[int]) -> int:
    """Cost of the edits that a mapping of a's nodes (-1: deleted) stands for."""
    (ta, ea), (tb, eb) = a, b
    mapped = sum(j >= 0 for j in to)
    renamed = sum(j >= 0 and ta[i] != tb[j] for i, j in enumerate(to))
    kept = sum(to[x] >= 0 and to[y] >= 0 and (to[x], to[y]) in eb for x, y in ea)
    return len(ta) + len(tb) - 2 * mapped + renamed + len(ea) + len(eb) - 2 * kept


def _aligned(a: Graph, b: Graph, run: int) -> list[int]:
    """A mapping that keeps the order of the nodes: the best alignment of their types, where `run` rewards pairs that follow upon each other."""
    ta, tb = a[0], b[0]
    n, m = len(ta), len(tb)
    last = [(0, False)] * (m + 1)  # gain, and whether the pair before is one
    choice: list[list[int]] = []
    for i in range(n):
        row, made = [(0, False)], []
        for j in range(m):
            gain, follows = last[j]
            pair = gain + (4 if ta[i] == tb[j] else 1) + (run if follows else 0)
            best = max((pair, 2), (last[j + 1][0], 1), (row[j][0], 0))
            made.append(best[1])
            row.append((best[0], best[1] == 2))
        choice.append(made)
        last = row
    to, i, j = [-1] * n, n - 1, m - 1
    while i >= 0 and j >= 0:
        move = choice[i][j]
        if move == 2:
            to[i] = j
        i, j = i - (move > 0), j - (move != 1)
    return to


class _Search:
    """Branch and bound over mappings of a's nodes, one after the other. What is left must cost at least what the counts of types and of edges by the types of their
    ends demand; a renamed node can pass for another type at as many edges as it has."""

    def __init__(self, a: Graph, b: Graph, best: int, budget: int) -> None:
        (self.ta, self.ea), (self.tb, self.eb) = a, b
        self.n, self.m, self.best, self.budget, self.steps = len(self.ta), len(self.tb), best, budget, 0
        self.at_a = self._incident(self.ea, self.n)
        self.at_b = self._incident(self.eb, self.m)
        self.follow = [0] * (self.n + 1)  # most edges of a node from there on
        for i in reversed(range(self.n)):
            self.follow[i] = max(self.follow[i + 1], len(self.at_a[i]))
        self.label, self.to, self.of = list(self.ta), [-2] * self.n, [-1] * self.m
        self.types: Counter = Counter(self.ta)
        self.types.subtract(self.tb)
        self.kinds: Counter = Counter((self.ta[x], self.ta[y]) for x, y in self.ea)
        self.kinds.subtract((self.tb[x], self.tb[y]) for x, y in self.eb)
        self.live_a, self.live_b = set(self.ea), set(self.eb)
        self.left_b, self.cost = self.m, 0
        self.off_types, self.off_kinds = sum(map(abs, self.types.values())), sum(map(abs, self.kinds.values()))
        self.undo: list[list] = []

    @staticmethod
    def _incident(edges: set[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for x, y in edges:
            out[x].append((x, y))
            if y != x:
                out[y].append((x, y))
        return out

    def _count(self, name: str, key: object, by: int) -> None:
        c: Counter = getattr(self, name)
        off = "off_" + name
        setattr(self, off, getattr(self, off) - abs(c[key]) + abs(c[key] + by))
        c[key] += by
        self.undo[-1].append((name, key, -by))

    def bound(self, i: int) -> int:
        nodes, edges, most = abs(self.n - i - self.left_b), abs(len(self.live_a) - len(self.live_b)), 2 * self.follow[i]
        best, s = 1 << 60, 0
        while True:
            d, e = self.off_types - 2 * s, self.off_kinds - most * s
            best = min(best, s + max(nodes, d) + max(edges, e))
            if d <= nodes and e <= edges or s >= min(self.n - i, self.left_b):
                return best
            s += 1

    def _drop(self, side: str, edge: tuple[int, int]) -> None:
        live, names = (self.live_a, self.label) if side == "a" else (self.live_b, self.tb)
        live.discard(edge)
        self._count("kinds", (names[edge[0]], names[edge[1]]), -1 if side == "a" else 1)
        self.undo[-1].append((side, edge, 0))

    def place(self, i: int, j: int) -> None:
        """Maps node i to j (-1: deletes it)."""
        self.undo.append([("cost", self.cost, 0)])
        self._count("types", self.ta[i], -1)
        self.to[i] = j
        if j < 0:
            gone = [e for e in self.at_a[i] if e in self.live_a]
            self.cost += 1 + len(gone)
            for e in gone:
                self._drop("a", e)
            return
        self._count("types", self.tb[j], 1)
        self.of[j], self.left_b = i, self.left_b - 1
        self.cost += self.ta[i] != self.tb[j]
        hits = 0
        for x, y in self.at_a[i]:
            if (x, y) in self.live_a and self.to[x] >= 0 and self.to[y] >= 0:
                hit = (self.to[x], self.to[y]) in self.eb
                hits += hit
                self.cost += not hit
                self._drop("a", (x, y))
        settled = [(x, y) for x, y in self.at_b[j] if (x, y) in self.live_b and self.of[x] >= 0 and self.of[y] >= 0]
        self.cost += len(settled) - hits
        for e in settled:
            self._drop("b", e)
        if self.ta[i] != self.tb[j]:  # from now on its edges pass for those of its new type
            mine = [e for e in self.at_a[i] if e in self.live_a]
            for x, y in mine:
                self._count("kinds", (self.label[x], self.label[y]), -1)
            self.label[i] = self.tb[j]
            for x, y in mine:
                self._count("kinds", (self.label[x], self.label[y]), 1)

    def back(self, i: int) -> None:
        j = self.to[i]
        for name, key, by in reversed(self.undo.pop()):
            if name == "cost":
                self.cost = key
            elif name == "a":
                self.live_a.add(key)
            elif name == "b":
                self.live_b.add(key)
            else:
                c: Counter = getattr(self, name)
                off = "off_" + name
                setattr(self, off, getattr(self, off) - abs(c[key]) + abs(c[key] + by))
                c[key] += by
        self.label[i], self.to[i] = self.ta[i], -2
        if j >= 0:
            self.of[j], self.left_b = -1, self.left_b + 1

    def _near(self, i: int) -> list[int]:
        """Free nodes of b that an edge of i can be kept with."""
        out: dict[int, int] = {}
        for x, y in self.at_a[i]:
            other = y if x == i else x
            p = self.to[other]
            if other != i and p >= 0:
                for u, v in self.at_b[p]:
                    q = v if x == other else u
                    if (u if x == other else v) == p and q != p and self.of[q] < 0:
                        out[q] = out.get(q, 0) + 1
        return sorted(out, key=lambda q: (-out[q], self.ta[i] != self.tb[q], abs(i - q)))

    def _options(self, i: int) -> Iterator[int]:
        near = self._near(i)
        yield from near
        known = {*near}
        settled = sum((x, y) in self.live_a and (self.to[x] >= 0 or self.to[y] >= 0) for x, y in self.at_a[i])
        if self.cost + settled < self.best:  # any other node loses all these edges
            free = [j for j in range(self.m) if self.of[j] < 0 and j not in known]
            yield from sorted(free, key=lambda j: (self.ta[i] != self.tb[j], abs(i - j)))
        yield -1

    def run(self) -> bool:
        """Whether all that could be better than the best one has been tried."""
        stack = [self._options(0)] if self.n else []
        while stack:
            i = len(stack) - 1
            j = next(stack[-1], None)
            if j is None:
                stack.pop()
                if stack:
                    self.back(i - 1)
                continue
            self.steps += 1
            if self.steps > self.budget:
                return False
            self.place(i, j)
            if i + 1 == self.n:
                self.best = min(self.best, self.cost + self.left_b + len(self.live_b))
                self.back(i)
            elif self.cost + self.bound(i + 1) >= self.best:
                self.back(i)
            else:
                stack.append(self._options(i + 1))
        return True


def graph_distance(a: Graph, b: Graph, budget: int = 40_000) -> tuple[int, bool]:
    """Unit-cost edit distance of two directed graphs with typed nodes (substituting a node of another type costs 1, edges have no type), and whether it is proven exact.

    The first solutions are alignments that keep the order of the nodes; branch and bound goes on from there. Past `budget` steps the best found so far is returned as an upper bound."""
    if not a[0] or not b[0]:
        return len(a[0]) + len(b[0]) + len(a[1]) + len(b[1]), True
    if len(a[0]) > len(b[0]):
        a, b = b, a  # the distance is the same either way, and fewer nodes to map are sooner done
    best = min(_mapping_cost(a, b, _aligned(a, b, run)) for run in (0, 1, 4))
    search = _Search(a, b, best, budget)
    if search.bound(0) >= best:
        return best, True
    exact = search.run()
    return search.best, exact


def graph_edits(gt: str, pred: str, grammar: Grammar, by_page: bool = True) -> tuple[int, int, bool]:
    """Edits, size of the truth (nodes and edges), and whether the edits are exact; by page, the document and edges between pages aside."""
    (na, ea), (nb, eb) = layout_graph(gt, grammar), layout_graph(pred, grammar)
    size = len(na) + len(ea)
    if not by_page:
        d, exact = graph_distance(([t for t, _ in na], set(ea)), ([t for t, _ in nb], set(eb)))
        return d, size, exact

    def of(nodes: list[tuple[str, int]], edges: list[tuple[int, int]], page: int) -> tuple[list[str], set[tuple[int, int]]]:
        mine = {i: k for k, i in enumerate(i for i, (_, p) in enumerate(nodes) if p == page)}
        return [nodes[i][0] for i in mine], {(mine[x], mine[y]) for x, y in edges if x in mine and y in mine}

    total, exact = 0, True
    for page in range(1, max([p for _, p in na + nb]) + 1):
        d, sure = graph_distance(of(na, ea, page), of(nb, eb, page))
        total, exact = total + d, exact and sure
    return total, size, exact


def loer_rows(df: DataFrame, key: str, grammar: Grammar, by_page: bool = True) -> DataFrame:
    """key, edits, size, exact of (key, gt, pred)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [graph_edits(g or "", p or "", grammar, by_page) for g, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], [key, "edits", "size", "exact"])

    return spread(df.select(key, "gt", "pred")).mapInArrow(run, f"`{key}` {kind}, edits bigint, size bigint, exact boolean")


# ---- average precision -------------------------------------------------------------------------------------------


def average_precisions(truths: list[str], preds: list[str], thresholds: list[float]) -> list[float]:
    """AP at each threshold. Predictions, in order, each take the closest truth still free if its error rate is within the threshold (ties: the first); empty truths can't be taken but count.

    AP is the sum of the gains in recall, each times the best precision reached from there on; without truths it is 0."""
    free = [t for t in truths if t]
    most = max(thresholds, default=0.0)  # a rate beyond it is no hit whatever it is; lengths alone rule most of these out
    rates = [[edits(t, p) / len(t) if abs(len(t) - len(p)) <= most * len(t) else float("inf") for t in free] for p in preds]
    out = []
    for threshold in thresholds:
        left = list(range(len(free)))
        hits = []
        for row in rates:
            best = min(left, key=row.__getitem__, default=None)
            hits.append(best is not None and row[best] <= threshold)
            if hits[-1]:
                left.remove(best)
        total = top = 0.0
        found = sum(hits)
        for k in range(len(hits), 0, -1):
            top = max(top, found / k)
            if hits[k - 1]:
                total += top
                found -= 1
        out.append(total / len(truths) if truths else 0.0)
    return out


def ap_table(rows: DataFrame, thresholds: range = range(5, 51, 5)) -> DataFrame:
    """record_id, class, threshold (per cent), ap, weight of (record_id, class, t, p): strings of truth and, by falling confidence, of the prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, kind, t, p in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(key, kind, n, ap, len(t)) for n, ap in zip(thresholds, average_precisions(t, p or [], [n / 100 for n in thresholds]))]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64()))], ["record_id", "class", "threshold", "ap", "weight"])

    return spread(rows.select("record_id", "class", "t", "p")).mapInArrow(run, "record_id bigint, class string, threshold int, ap double, weight bigint")
