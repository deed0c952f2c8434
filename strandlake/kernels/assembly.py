"""Local assembly: haplotypes of a region from its reads, by a k-mer graph around the reference."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict

#: K-mer sizes whose haplotypes are pooled, larger ones to try in turn where those fail, smallest edge weight of a path that isn't the
#: reference, and how many haplotypes a graph gives.
KMER_SIZES, LARGER_SIZES, MIN_WEIGHT, MAX_HAPLOTYPES = (10, 25), (35, 45, 55, 65, 75, 85), 2, 128


class KmerGraph:
    """Vertices are k-mers, edges hold how many sequences go over them and whether the reference does."""

    def __init__(self, k: int):
        self.k = k
        self.weight: dict[tuple[str, str], int] = defaultdict(int)
        self.is_ref: set[tuple[str, str]] = set()
        self.after: dict[str, set[str]] = defaultdict(set)
        self.before: dict[str, set[str]] = defaultdict(set)

    def add(self, seq: str, is_ref: bool = False, times: int = 1) -> None:
        """Thread a sequence that occurs so many times; k-mers with N break it."""
        k = self.k
        if len(seq) <= k:
            return
        kmers = [seq[i : i + k] for i in range(len(seq) - k + 1)]
        edges = list(zip(kmers, kmers[1:], strict=False))
        if "N" in seq:
            edges = [(a, b) for a, b in edges if "N" not in a and "N" not in b]
        weight, after, before = self.weight, self.after, self.before
        for edge in edges:
            if edge in weight:
                weight[edge] += times
            else:
                weight[edge] = times
                after[edge[0]].add(edge[1])
                before[edge[1]].add(edge[0])
        if is_ref:
            self.is_ref.update(edges)

    def link(self, edge: tuple[str, str], times: int) -> None:
        if edge in self.weight:
            self.weight[edge] += times
        else:
            self.weight[edge] = times
            self.after[edge[0]].add(edge[1])
            self.before[edge[1]].add(edge[0])

    def drop(self, edge: tuple[str, str]) -> None:
        self.weight.pop(edge, None)
        self.after[edge[0]].discard(edge[1])
        self.before[edge[1]].discard(edge[0])

    def prune(self, least: int = MIN_WEIGHT) -> None:
        """Drop linear chains whose edges are all light and none of the reference."""
        seen: set[tuple[str, str]] = set()
        for edge in [e for e, n in self.weight.items() if n < least and e not in self.is_ref]:  # chains of others stay
            if edge in seen or edge not in self.weight:
                continue
            chain, held = [edge], {edge}
            v = edge[1]
            while len(self.after[v]) == 1 and len(self.before[v]) == 1:
                (to,) = self.after[v]
                if (v, to) in held:
                    break
                chain.append((v, to))
                held.add((v, to))
                v = to
            v = edge[0]
            while len(self.before[v]) == 1 and len(self.after[v]) == 1:
                (origin,) = self.before[v]
                if (origin, v) in held:
                    break
                chain.append((origin, v))
                held.add((origin, v))
                v = origin
            seen.update(chain)
            if all(self.weight[e] < least and e not in self.is_ref for e in chain):
                for e in chain:
                    self.drop(e)

    def has_cycle(self) -> bool:
        """By taking away vertices without predecessors until none is left."""
        degree = {v: len(p) for v, p in self.before.items()}
        vertices = {v for e in self.weight for v in e}
        ready = [v for v in vertices if not degree.get(v)]
        done = 0
        while ready:
            v = ready.pop()
            done += 1
            for w in self.after[v]:
                degree[w] -= 1
                if not degree[w]:
                    ready.append(w)
        return done < len(vertices)

    def sources(self) -> set[str]:
        return {a for a, _ in self.weight if not self.before.get(a)}

    def sinks(self) -> set[str]:
        return {b for _, b in self.weight if not self.after.get(b)}

    def leaves_and_returns(self, place: dict[str, int]) -> bool:
        """``has_cycle`` where the reference's vertices have these places along one path: what leaves it must come back further on, and what lies beside it have no cycle.

        Only vertices beside the reference are looked at: each knows the last place that leads to it.
        """
        beside = {v for v in self.before if v not in place and self.before[v]} | {v for v in self.after if v not in place and self.after[v]}
        for v, targets in self.after.items():
            if len(targets) > 1 and v in place and any(place.get(w, math.inf) <= place[v] for w in targets):
                return True
        degree, last = {}, {}
        for v in beside:
            origins = self.before.get(v, ())
            degree[v] = sum(o not in place for o in origins)
            last[v] = max((place[o] for o in origins if o in place), default=-1)
        ready = [v for v in beside if not degree[v]]
        done = 0
        while ready:
            v = ready.pop()
            done += 1
            for w in self.after.get(v, ()):
                if w in place:
                    if place[w] <= last[v]:
                        return True
                else:
                    last[w] = max(last[w], last[v])
                    degree[w] -= 1
                    if not degree[w]:
                        ready.append(w)
        return done < len(beside)

    def best_paths(self, source: str, sink: str, most: int = MAX_HAPLOTYPES, connected: bool = False) -> list[tuple[float, str]]:
        """(log10 score, sequence) of the best paths; an edge scores its share of its origin's weight.

        The cost still to come is known exactly from a backward pass (the graph has no cycle), so paths leave the heap in order. Stretches
        with one way on cost nothing and are gone over at once. connected: edges that don't lead to the sink are as if they weren't there.
        """

        def onward(v: str) -> tuple[str, str]:
            letters = []
            while v != sink and len(self.after[v]) == 1:
                (v,) = self.after[v]
                letters.append(v[-1])
            return v, "".join(letters)

        first, begun = onward(source)
        steps: dict[str, list[tuple[float, str, str]]] = {}  # (weight, then cost, text, next place to choose) from each place to choose
        order, seen, stack = [], {first}, [first]
        while stack:
            v = stack[-1]
            if v not in steps:
                steps[v] = [(self.weight[v, w], w[-1] + text, to) for w in sorted(self.after[v]) for to, text in (onward(w),)] if v != sink else []
            after = next((to for _, _, to in steps[v] if to not in seen), None)
            if after is None:
                order.append(stack.pop())
            else:
                seen.add(after)
                stack.append(after)
        rest: dict[str, float] = {sink: 0.0}
        for v in order:
            if v != sink:
                ways = [x for x in steps[v] if rest.get(x[2], math.inf) < math.inf] if connected else steps[v]
                total = sum(weight for weight, _, _ in ways)
                steps[v] = [(-math.log10(weight / total), text, to) for weight, text, to in ways]
                rest[v] = min((cost + rest[to] for cost, _, to in steps[v] if rest.get(to, math.inf) < math.inf), default=math.inf)
        heap = [(rest.get(first, math.inf), 0, 0.0, first, source + begun)]
        found, n = [], 0
        while heap and len(found) < most:
            bound, _, so_far, v, text = heapq.heappop(heap)
            if bound == math.inf:
                break
            if v == sink:
                found.append((-so_far, text))
                continue
            for cost, more, to in steps[v]:
                n += 1
                heapq.heappush(heap, (so_far + cost + rest.get(to, math.inf), n, so_far + cost, to, text + more))
        return found


def repeated_kmers(seq: str, k: int) -> set[str]:
    seen, twice = set(), set()
    for i in range(len(seq) - k + 1):
        x = seq[i : i + k]
        (twice if x in seen else seen).add(x)
    return twice


def _all_onward(place: dict[str, int], reads: list[list[str]]) -> bool:
    """Whether the vertices of reads get places, beside those of the reference, that grow along every read. Then there is no cycle; else there may be one."""
    known = dict(place)
    for n, own in enumerate(reads, 1):
        first = next((i for i, x in enumerate(own) if x in known), None)
        last = (known[own[first]] - first if first is not None else -n << 20) - 1
        for x in own:
            p = known.get(x)
            if p is None:
                p = known[x] = last + 1
            elif p <= last:
                return False
            last = p
    return True


def _paths(ref: str, reads: list[str | tuple[str, int]], k: int, least: int, most: int) -> list[tuple[float, str]]:
    """Haplotypes of one k-mer size; none where the reference repeats a k-mer or the graph has a cycle. Ends that dangle are joined to the reference where they agree with it."""
    from strandlake.kernels import seqgraph  # which is built on this module's graph

    if len(ref) <= k or "N" in ref:
        return []
    kmers = [ref[i : i + k] for i in range(len(ref) - k + 1)]
    place = dict(zip(kmers, range(len(kmers)), strict=True))
    if len(place) < len(kmers):
        return []
    graph = KmerGraph(k)
    graph.add(ref, is_ref=True)
    along = list(zip(kmers, kmers[1:], strict=False))
    off, met = [], Counter()
    for read in reads:
        seq, times = (read, 1) if isinstance(read, str) else read
        if len(seq) <= k:
            continue
        at = ref.find(seq)
        if at >= 0:
            for edge in along[at : at + len(seq) - k]:
                graph.weight[edge] += times
            continue
        own = [seq[i : i + k] for i in range(len(seq) - k + 1)]
        places = list(map(place.get, own))
        met.update([x for x, p in zip(own, places, strict=True) if p is None])
        off.append((seq, own, places, times))
    for seq, own, places, times in off:
        if times >= least or "N" in seq:
            graph.add(seq, times=times)
            continue
        # What a light read shows between two places of the reference (or an end of it) and no other does is pruned, unless it makes a cycle.
        at, upto = 0, len(own)
        edges = list(zip(own, own[1:], strict=False))
        while at < upto:
            if places[at] is not None:
                if at and places[at - 1] is not None:
                    graph.link(edges[at - 1], times)
                at += 1
                continue
            end = at
            while end < upto and places[end] is None:
                end += 1
            if all(met[x] == 1 for x in own[at:end]):
                if at and end < upto and places[end] <= places[at - 1]:
                    return []
            else:
                for edge in edges[max(0, at - 1) : end]:
                    graph.link(edge, times)
            if end < upto:
                at = end + 1
            else:
                break
    if not _all_onward(place, [own for seq, own, _, _ in off]) and graph.leaves_and_returns(place):
        return []
    graph.prune(least)
    source, sink = ref[:k], ref[-k:]
    seqgraph.drop_beyond_reference(graph, source, sink)
    if seqgraph.recover_dangling(graph, ref, place=place) and graph.leaves_and_returns(place):
        return []
    return seqgraph.unique_best(graph.best_paths(source, sink, most, connected=True), most)


def only_reference(ref: str, reads: list[tuple[str, int]], sizes: tuple[int, ...], least: int = MIN_WEIGHT) -> bool:
    """Whether no graph of these sizes can hold another haplotype, seen without building one.

    An edge that isn't the reference's and lighter than ``least`` is pruned, but for stretches that hang on the reference's ends, which lead nowhere. So where all
    such edges are light, a graph gives the reference at a cost of 0, or nothing.
    """
    off = [(s, n) for s, n in reads if s not in ref]
    if not off:
        return True
    if sum(n for _, n in off) < least and len(off) == 1:
        seq, k = off[0][0], min(sizes)
        if len({seq[i : i + k + 1] for i in range(len(seq) - k)}) == max(0, len(seq) - k):
            return True
    for k in sizes:
        if len(ref) <= k:
            continue  # no graph
        known = {ref[i : i + k + 1] for i in range(len(ref) - k)}
        seen: dict[str, int] = {}
        for seq, n in off:
            for i in range(len(seq) - k):
                x = seq[i : i + k + 1]
                if x not in known:
                    if (times := seen.get(x, 0) + n) >= least:
                        return False
                    seen[x] = times
    return True


def assemble(ref: str, reads: list[str | tuple[str, int]], sizes: tuple[int, ...] = KMER_SIZES, least: int = MIN_WEIGHT, most: int = MAX_HAPLOTYPES, larger: tuple[int, ...] = LARGER_SIZES) -> list[tuple[float, str]]:
    """Haplotypes (score, sequence) from the graphs of all ``sizes``, or where none works from the first of the ``larger`` sizes that does; the reference is always one.

    A read is a sequence, or one with how often it occurs. A haplotype of several graphs has its best score.
    """
    counted = [(r, 1) if isinstance(r, str) else r for r in reads]
    if only_reference(ref, counted, (*sizes, *larger), least):
        return [(0.0, ref)]
    found: dict[str, float] = {}
    for k in (*sizes, *larger):
        if found and k not in sizes:
            break
        for score, text in _paths(ref, reads, k, least, most):
            found[text] = max(score, found.get(text, -math.inf))
    if not found:
        return [(0.0, ref)]
    found.setdefault(ref, -math.inf)
    return sorted(((score, text) for text, score in found.items()), key=lambda x: (-x[0], x[1]))


def haplotype_events(ops: list[tuple[str, int]], ref: str, haplotype: str, start: int) -> list[tuple[int, str, str]]:
    """(position, ref allele, alt allele) of an aligned haplotype; indels have the base before them in front."""
    events, r, h = [], 0, 0
    for op, n in ops:
        if op == "M":
            events += [(start + r + i, ref[r + i], haplotype[h + i]) for i in range(n) if ref[r + i] != haplotype[h + i]]
            r, h = r + n, h + n
        elif op == "D":
            if r:
                events.append((start + r - 1, ref[r - 1 : r + n], ref[r - 1]))
            r += n
        elif op == "I":
            if r:
                events.append((start + r - 1, ref[r - 1], ref[r - 1] + haplotype[h : h + n]))
            h += n
        elif op == "S":
            h += n
    return events
