"""Graphs of sequences: k-mer graphs cleaned around their reference, and graphs whose vertices are stretches of bases, simplified without changing what they spell."""

from __future__ import annotations

from collections import defaultdict

from strandlake.kernels.assembly import KmerGraph

#: Bases that a dangling end must share with the reference, the largest indel of it, and counts of k-mers that are errors or to be trusted.
MIN_MATCH, MAX_SHIFT, ERROR_COUNT, TRUSTED_COUNT = 8, 10, 1, 20


def common_prefix(texts: list[str]) -> int:
    n = 0
    for letters in zip(*texts, strict=False):
        if len(set(letters)) > 1:
            break
        n += 1
    return n


def common_suffix(texts: list[str]) -> int:
    return common_prefix([t[::-1] for t in texts])


def longest_suffix_match(text: str, kmer: str, end: int) -> int:
    """Length of the longest suffix of ``kmer`` that ends at place ``end`` (inclusive) of the text."""
    n = 0
    while n < len(kmer) and n <= end and text[end - n] == kmer[-1 - n]:
        n += 1
    return n


# k-mer graphs


def reference_path(graph: KmerGraph, source: str) -> list[str]:
    """Vertices along edges of the reference from a vertex on; empty if the vertex has none."""
    path, seen = [source], {source}
    while (after := next((w for w in sorted(graph.after[path[-1]]) if (path[-1], w) in graph.is_ref and w not in seen), None)) is not None:
        path.append(after)
        seen.add(after)
    return path if len(path) > 1 else []


def has_reference_path(graph: KmerGraph, source: str, sink: str) -> bool:
    path = reference_path(graph, source)
    return bool(path) and path[-1] == sink


def reference_bases(graph: KmerGraph, source: str) -> str:
    path = reference_path(graph, source)
    return path[0] + "".join(v[-1] for v in path[1:]) if path else ""


def _drop_vertices(graph: KmerGraph, gone: set[str]) -> None:
    for edge in [e for e in graph.weight if e[0] in gone or e[1] in gone]:
        graph.drop(edge)


def _reached(start: str, steps) -> set[str]:
    seen, stack = {start}, [start]
    while stack:
        for w in steps(stack.pop()):
            if w not in seen:
                seen.add(w)
                stack.append(w)
    return seen


def drop_beyond_reference(graph: KmerGraph, source: str, sink: str) -> None:
    """Without what leads into the reference's first vertex or out of its last one."""
    for edge in [*((v, source) for v in graph.before[source]), *((sink, v) for v in graph.after[sink])]:
        graph.drop(edge)


def drop_unconnected_paths(graph: KmerGraph, source: str, sink: str) -> None:
    """Only vertices on a path from source to sink."""
    kept = _reached(source, lambda v: graph.after[v]) & _reached(sink, lambda v: graph.before[v])
    _drop_vertices(graph, {v for e in graph.weight for v in e} - kept)


def drop_other_components(graph: KmerGraph, source: str) -> None:
    """Only vertices that hang together with the source, in whatever direction."""
    kept = _reached(source, lambda v: graph.after[v] | graph.before[v])
    _drop_vertices(graph, {v for e in graph.weight for v in e} - kept)


def orphans(graph: KmerGraph) -> set[str]:
    """Vertices that were in the graph and have no edge any more."""
    known = set(graph.after) | set(graph.before)
    return {v for v in known if not graph.after[v] and not graph.before[v]}


def recover_dangling(graph: KmerGraph, ref: str, least: int = MIN_MATCH, most: int = MAX_SHIFT, place: dict[str, int] | None = None) -> int:
    """Join paths that leave the reference and end, or begin and meet it, back to it where they agree with it; how many were joined.

    A tail is laid along the reference from where it left, moved by up to ``most`` bases for an indel; the place where most of its last bases
    agree is taken if those are ``least`` or more. A head needs its first k-mer but for the last base to be the reference's.
    """
    k = graph.k
    place = place or {ref[i : i + k]: i for i in range(len(ref) - k + 1)}
    joined = 0
    first, last = ref[:k], ref[-k:]
    for tip in sorted(v for v in graph.sinks() if v != last):
        path = [tip]
        while path[-1] not in place and len(graph.before[path[-1]]) == 1:
            (back,) = graph.before[path[-1]]
            path.append(back)
        if path[-1] not in place or len(path) < 2 or tip in place:
            continue
        at = place[path[-1]]
        text = path[-1] + "".join(v[-1] for v in reversed(path[:-1]))
        best = (0, 0)
        for shift in sorted(range(-most, most + 1), key=abs):
            end = at + len(text) + shift
            if at + k <= end < len(ref):
                n = common_suffix([text[k:], ref[at + k : end]])
                if n > best[0]:
                    best = (n, end)
        if best[0] >= min(least, len(text) - k):
            target = ref[best[1] - k + 1 : best[1] + 1]
            weight = graph.weight[path[1], tip]
            graph.weight[tip, target] += weight
            graph.after[tip].add(target)
            graph.before[target].add(tip)
            joined += 1
    for head in sorted(v for v in graph.sources() if v != first):
        if head in place:
            continue
        at = ref.find(head[:-1])
        if at > 0 and ref.find(head[:-1], at + 1) < 0:
            origin = ref[at - 1 : at - 1 + k]
            weight = max((graph.weight[head, w] for w in graph.after[head]), default=1)
            graph.weight[origin, head] += weight
            graph.after[origin].add(head)
            graph.before[head].add(origin)
            joined += 1
    return joined


# graphs of sequences


class SeqGraph:
    """Vertices have texts, edges weights and whether the reference goes over them. A path spells the texts of its vertices one after the other."""

    def __init__(self):
        self.text: dict[int, str] = {}
        self.edges: dict[tuple[int, int], tuple[int, bool]] = {}
        self._next = 0

    def add(self, text: str) -> int:
        self.text[self._next] = text
        self._next += 1
        return self._next - 1

    def link(self, a: int, b: int, weight: int = 1, is_ref: bool = False) -> None:
        """Add an edge, or add up with one that is there."""
        held = self.edges.get((a, b), (0, False))
        self.edges[a, b] = (held[0] + weight, held[1] or is_ref)

    def after(self, v: int) -> list[int]:
        return sorted(b for a, b in self.edges if a == v)

    def before(self, v: int) -> list[int]:
        return sorted(a for a, b in self.edges if b == v)

    def drop(self, v: int) -> None:
        del self.text[v]
        self.edges = {e: w for e, w in self.edges.items() if v not in e}

    def sources(self) -> list[int]:
        return sorted(v for v in self.text if not self.before(v))

    def sinks(self) -> list[int]:
        return sorted(v for v in self.text if not self.after(v))

    def spelled(self, most: int = 10_000) -> set[str]:
        """The texts of all paths from a source to a sink; too many are an error."""
        out: set[str] = set()
        stack = [(v, self.text[v]) for v in self.sources()]
        while stack:
            v, text = stack.pop()
            targets = self.after(v)
            if not targets:
                out.add(text)
                if len(out) > most:
                    raise ValueError(f"more than {most} paths")
            stack += [(w, text + self.text[w]) for w in targets]
        return out

    def zip_chains(self) -> bool:
        """Join runs of vertices with one way out and one way in."""
        changed = False
        for v in sorted(self.text):
            while v in self.text and len(targets := self.after(v)) == 1 and targets[0] != v and len(self.before(targets[0])) == 1:
                (w,) = targets
                self.text[v] += self.text[w]
                further = [(b, self.edges[w, b]) for b in self.after(w)]
                self.drop(w)
                for b, (weight, is_ref) in further:
                    self.link(v, b if b != w else v, weight, is_ref)
                changed = True
        return changed

    def split_common_suffix(self, v: int) -> bool:
        """Give the suffix that all predecessors of a vertex share a vertex of its own between them and it."""
        sides = self.before(v)
        if len(sides) < 2 or any(self.after(a) != [v] for a in sides) or v in sides:
            return False
        n = common_suffix([self.text[a] for a in sides])
        if not n or all(len(self.text[a]) == n and not self.before(a) for a in sides):
            return False
        shared = self.add(self.text[sides[0]][len(self.text[sides[0]]) - n :])
        for a in sides:
            weight, is_ref = self.edges.pop((a, v))
            self.text[a] = self.text[a][: len(self.text[a]) - n]
            self.link(a, shared, weight, is_ref)
            self.link(shared, v, weight, is_ref)
        for a in [a for a in sides if not self.text[a]]:  # wholly shared: its predecessors lead on to the shared one
            weight, is_ref = self.edges[a, shared]
            origins = [(o, self.edges[o, a]) for o in self.before(a)]
            if origins:
                self.drop(a)
                for o, (w, r) in origins:
                    self.link(o, shared, w, r)
        return True

    def merge_twins(self, v: int) -> bool:
        """Make one of predecessors of a vertex that have the same text and lead nowhere else."""
        groups: dict[str, list[int]] = defaultdict(list)
        for a in self.before(v):
            if self.after(a) == [v] and a != v:
                groups[self.text[a]].append(a)
        changed = False
        for twins in groups.values():
            kept, *others = twins
            for a in others:
                for o in self.before(a):
                    self.link(o, kept, *self.edges[o, a])
                self.link(kept, v, *self.edges[a, v])
                self.drop(a)
                changed = True
        return changed

    def split_diamonds(self, v: int) -> bool:
        """Give the prefix that all successors of a vertex share to the vertex itself, where they have no other way in."""
        sides = self.after(v)
        if len(sides) < 2 or any(self.before(a) != [v] for a in sides):
            return False
        n = min(common_prefix([self.text[a] for a in sides]), min(len(self.text[a]) for a in sides) - 1)
        if n <= 0:
            return False
        self.text[v] += self.text[sides[0]][:n]
        for a in sides:
            self.text[a] = self.text[a][n:]
        return True

    def simplify(self, rounds: int = 100) -> SeqGraph:
        """Chains zipped, shared ends split off and twins merged until nothing changes; the graph spells what it did before."""
        for _ in range(rounds):
            changed = self.zip_chains()
            for v in sorted(self.text):
                if v in self.text:
                    changed |= self.merge_twins(v)
            for v in sorted(self.text):
                if v in self.text:
                    changed |= self.split_diamonds(v) or self.split_common_suffix(v)
            if not changed:
                break
        return self

    def route(self, text: str) -> list[int] | None:
        """A path from a source to a sink that spells the text, or None."""
        stack = [(v, len(self.text[v]), [v]) for v in self.sources() if text.startswith(self.text[v])]
        while stack:
            v, at, path = stack.pop()
            targets = self.after(v)
            if at == len(text) and not targets:
                return path
            stack += [(w, at + len(self.text[w]), [*path, w]) for w in targets if text.startswith(self.text[w], at)]
        return None


def to_sequences(graph: KmerGraph) -> SeqGraph:
    """A k-mer graph as a graph of sequences: vertices without a way in have their whole k-mer, all others its last base."""
    out = SeqGraph()
    vertices = sorted({v for e in graph.weight for v in e})
    number = {v: out.add(v if not graph.before[v] else v[-1]) for v in vertices}
    for (a, b), weight in graph.weight.items():
        out.link(number[a], number[b], weight, (a, b) in graph.is_ref)
    return out


def unique_best(paths: list[tuple[float, str]], most: int) -> list[tuple[float, str]]:
    """The best path of each distinct sequence, the best first."""
    best: dict[str, float] = {}
    for score, text in paths:
        best[text] = max(score, best.get(text, float("-inf")))
    return sorted(((s, t) for t, s in best.items()), key=lambda x: (-x[0], x[1]))[:most]


def corrected(reads: list[str], k: int = 25, error: int = ERROR_COUNT, trusted: int = TRUSTED_COUNT, differing: int = 1) -> list[str]:
    """Reads with bases changed where every k-mer over them that is rare has a frequent one that differs in just them.

    Rare k-mers occur at most ``error`` times in all reads, frequent ones at least ``trusted`` times. A base changes if all proposals for it agree.
    """
    if differing != 1:
        raise ValueError("one differing base is what is looked for")
    counts: dict[str, int] = defaultdict(int)
    for r in reads:
        for i in range(len(r) - k + 1):
            counts[r[i : i + k]] += 1
    solid: dict[tuple[int, str], set[str]] = defaultdict(set)
    for kmer, n in counts.items():
        if n >= trusted:
            for j in range(k):
                solid[j, kmer[:j] + kmer[j + 1 :]].add(kmer[j])
    out = []
    for r in reads:
        proposals: dict[int, set[str]] = defaultdict(set)
        for i in range(len(r) - k + 1):
            kmer = r[i : i + k]
            if counts[kmer] <= error:
                found = [(j, b) for j in range(k) for b in solid.get((j, kmer[:j] + kmer[j + 1 :]), ()) if b != kmer[j]]
                if len(found) == 1:
                    proposals[i + found[0][0]].add(found[0][1])
        letters = list(r)
        for at, bases in proposals.items():
            if len(bases) == 1:
                (letters[at],) = bases
        out.append("".join(letters))
    return out


def edge_alignment(ref: str, query: str, align) -> list[tuple[str, int]]:
    """A global alignment: the common prefix and suffix as they are, what lies between by ``align(ref, query)``, which gives operations."""
    head = common_prefix([ref, query])
    tail = common_suffix([ref[head:], query[head:]])
    r, q = ref[head : len(ref) - tail], query[head : len(query) - tail]
    middle = [("I", len(q))] if q and not r else [("D", len(r))] if r and not q else align(r, q) if r else []
    ops: list[tuple[str, int]] = []
    for op, n in [("M", head), *middle, ("M", tail)]:
        if n and ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + n)
        elif n:
            ops.append((op, n))
    return ops
