"""Exact invariants of many small graphs at once, over the lattice of vertex subsets.

A ``Lattice`` holds graphs with the same number of vertices n. Most of its arrays have an entry for each graph and
each of the 2^n subsets and are filled by loops over bits, not over graphs or subsets; they are computed when first
asked for, so a caller pays for what it selects. Meant for n <= 12.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

MOST_VERTICES = 12
CYCLE_LENGTHS = range(3, 11)


def decode(texts: list[str]) -> np.ndarray:
    """(graphs, n) neighbour masks of graph6 texts with the same n."""
    raw = np.frombuffer("".join(texts).encode("ascii"), np.uint8).reshape(len(texts), -1).astype(np.int64) - 63
    n = int(raw[0, 0])
    adj = np.zeros((len(texts), n), np.int64)
    for j in range(1, n):
        for i in range(j):
            k = j * (j - 1) // 2 + i
            bit = raw[:, 1 + k // 6] >> 5 - k % 6 & 1
            adj[:, i] |= bit << j
            adj[:, j] |= bit << i
    return adj


def walks(adj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the vertices that walks of even and of odd length reach from vertex 0, for any number of vertices. They
    have all vertices if the graph is connected, and then one in common if it is not bipartite."""
    even, odd = np.ones(len(adj), np.int64), np.zeros(len(adj), np.int64)
    for _ in range(adj.shape[1]):
        for v in range(adj.shape[1]):
            odd |= np.where(even >> v & 1, adj[:, v], 0)
        for v in range(adj.shape[1]):
            even |= np.where(odd >> v & 1, adj[:, v], 0)
    return even, odd


def forms(adj: np.ndarray) -> list[str]:
    """graph6 texts with the vertices in the order of their colours: degrees and triangles, refined by the neighbours'
    colours, the first vertex of the least colour that repeats set apart, and again until none repeats."""
    count, n = adj.shape
    a = (adj[:, :, None] >> np.arange(n) & 1).astype(np.uint64)
    odd, one = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> np.uint64(31)) * odd
        return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)

    colour = mixed(a.sum(axis=2) * np.uint64(64) + ((a @ a) * a).sum(axis=2))
    for _ in range(n):
        for _ in range(3):
            colour = mixed(colour + (a * mixed(colour)[:, None, :]).sum(axis=2))
        order = np.argsort(colour, axis=1, kind="stable")
        ranked = np.take_along_axis(colour, order, axis=1)
        again = ranked[:, 1:] == ranked[:, :-1]
        tied = np.flatnonzero(again.any(axis=1))
        if not len(tied):
            break
        colour[tied, order[tied, again[tied].argmax(axis=1)]] += one
    order = np.argsort(colour, axis=1, kind="stable")
    a = a[np.arange(count)[:, None, None], order[:, :, None], order[:, None, :]]
    chars = -(-n * (n - 1) // 12)
    bits = np.zeros((count, chars * 6), np.uint8)
    for j in range(1, n):
        bits[:, j * (j - 1) // 2 : j * (j + 1) // 2] = a[:, :j, j]
    text = np.full((count, chars + 1), 63 + n, np.uint8)
    text[:, 1:] = 63 + (bits.reshape(count, chars, 6) << np.arange(5, -1, -1)).sum(axis=2)
    whole = text.tobytes().decode("ascii")
    return [whole[k : k + chars + 1] for k in range(0, len(whole), chars + 1)]


class Lattice:
    def __init__(self, adj: np.ndarray):
        self.adj, (self.count, self.n) = adj, adj.shape
        self.size = 1 << self.n
        self.all = self.size - 1
        self.sets = np.arange(self.size)
        self.pc = np.bitwise_count(self.sets).astype(np.int64)
        self.has = [self.sets >> v & 1 == 1 for v in range(self.n)]
        self.low = np.array([(s & -s).bit_length() - 1 for s in range(self.size)])

    def _at(self, table: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.take_along_axis(table, where, axis=1)

    @cached_property
    def matrix(self) -> np.ndarray:
        return self.adj[:, :, None] >> np.arange(self.n) & 1

    @cached_property
    def degrees(self) -> np.ndarray:
        return np.bitwise_count(self.adj).astype(np.int64)

    @cached_property
    def m(self) -> np.ndarray:
        return self.degrees.sum(axis=1) // 2

    @cached_property
    def near(self) -> np.ndarray:
        """Union of the neighbourhoods of a subset."""
        out = np.zeros((self.count, self.size), np.int64)
        for v in range(self.n):
            out[:, self.has[v]] |= self.adj[:, v, None]
        return out

    @cached_property
    def edges(self) -> np.ndarray:
        out = np.zeros((self.count, self.size), np.int64)
        for v in range(self.n):
            own = self.sets[self.has[v]]
            out[:, own] += np.bitwise_count(self.adj[:, v, None] & own)
        return out // 2

    @cached_property
    def component(self) -> np.ndarray:
        """The connected component of a subset's lowest vertex."""
        reach = np.broadcast_to(self.sets & -self.sets, (self.count, self.size)).copy()
        for _ in range(self.n - 1):
            reach |= self._at(self.near, reach) & self.sets
        return reach

    @cached_property
    def connected(self) -> np.ndarray:
        return (self.component == self.sets) & (self.sets > 0)

    @cached_property
    def components(self) -> np.ndarray:
        """Number of connected components of a subset."""
        out, rest = np.zeros((self.count, self.size), np.int64), np.broadcast_to(self.sets, (self.count, self.size)).copy()
        for _ in range(self.n):
            out += rest > 0
            rest ^= self._at(self.component, rest)
        return out

    @cached_property
    def induced(self) -> np.ndarray:
        """Is the subset the vertex set of a chordless cycle?"""
        out = self.connected & (self.pc >= 3)
        for v in range(self.n):
            own = self.sets[self.has[v]]
            out[:, own] &= np.bitwise_count(self.adj[:, v, None] & own) == 2
        return out

    @cached_property
    def nonbipartite(self) -> np.ndarray:
        """A subset is not bipartite if it holds a chordless odd cycle."""
        out = self.induced & (self.pc % 2 == 1)
        for v in range(self.n):
            out[:, self.has[v]] |= out[:, ~self.has[v]]
        return out

    @cached_property
    def cycles(self) -> np.ndarray:
        """Number of simple cycles with exactly this vertex set, by paths that begin at the lowest vertex."""
        paths = np.zeros((self.count, self.size, self.n), np.int64)
        for v in range(self.n):
            paths[:, 1 << v, v] = 1
        for k in range(2, self.n + 1):
            for w in range(self.n):
                own = self.sets[(self.pc == k) & self.has[w] & (self.low != w)]
                if len(own):
                    paths[:, own, w] = np.einsum("bsv,bv->bs", paths[:, own ^ 1 << w, :], self.matrix[:, :, w])
        out = np.zeros((self.count, self.size), np.int64)
        for v in range(self.n):
            own = self.sets[(self.low == v) & (self.pc >= 3)]
            out[:, own] = np.einsum("bsv,bv->bs", paths[:, own, :], self.matrix[:, :, v]) // 2
        return out

    @cached_property
    def blocks(self) -> np.ndarray:
        """Is the subset a biconnected block?"""
        two = self.connected & (self.pc >= 2)
        for v in range(self.n):
            own = self.sets[self.has[v] & (self.pc >= 3)]
            two[:, own] &= self.connected[:, own ^ 1 << v]
        wider, above = two.copy(), np.zeros_like(two)
        for k in range(self.n - 1, 0, -1):
            for v in range(self.n):
                own = self.sets[(self.pc == k) & ~self.has[v]]
                above[:, own] |= wider[:, own | 1 << v]
            own = self.sets[self.pc == k]
            wider[:, own] |= above[:, own]
        return two & ~above

    @cached_property
    def matching(self) -> np.ndarray:
        out = np.zeros((self.count, self.size), np.int64)
        for k in range(2, self.n + 1):
            for v in range(self.n):
                own = self.sets[(self.pc == k) & (self.low == v)]
                best = out[:, own ^ 1 << v]
                for u in range(v + 1, self.n):
                    with_u = self.has[u][own]
                    pair = out[:, own[with_u] ^ 1 << v ^ 1 << u] + 1
                    best[:, with_u] = np.maximum(best[:, with_u], np.where(self.matrix[:, v, u, None] == 1, pair, 0))
                out[:, own] = best
        return out

    @cached_property
    def chromatic(self) -> np.ndarray:
        """Least number of independent sets that cover all vertices."""

        def zeta(x: np.ndarray, sign: int) -> np.ndarray:
            for v in range(self.n):
                x[:, self.has[v]] += sign * x[:, ~self.has[v]]
            return x

        single = zeta((self.edges == 0).astype(np.int64), 1)
        covered, out = (self.edges == 0).astype(np.int64), np.zeros(self.count, np.int64)
        for k in range(1, self.n + 1):
            out = np.where((out == 0) & (covered[:, self.all] > 0), k, out)
            if (out > 0).all():
                break
            covered = (zeta(zeta(covered, 1) * single, -1) > 0).astype(np.int64)
        return out

    @cached_property
    def treewidth(self) -> np.ndarray:
        """Best elimination order of a subset: eliminating v last costs its neighbours beyond what it reaches through it."""
        cost = []
        for v in range(self.n):
            own = self.sets[~self.has[v]]
            reach = np.full((self.count, len(own)), 1 << v)
            for _ in range(self.n - 1):
                reach |= self._at(self.near, reach) & own
            cost.append((own, np.bitwise_count(self._at(self.near, reach) & ~(own | 1 << v)).astype(np.int64)))
        place = [np.searchsorted(own, np.arange(self.size)) for own, _ in cost]
        out = np.full((self.count, self.size), self.n, np.int64)
        out[:, 0] = 0
        for k in range(1, self.n + 1):
            for v in range(self.n):
                own = self.sets[(self.pc == k) & self.has[v]]
                out[:, own] = np.minimum(out[:, own], np.maximum(out[:, own ^ 1 << v], cost[v][1][:, place[v][own ^ 1 << v]]))
        return out[:, self.all]

    @cached_property
    def distance(self) -> np.ndarray:
        """(graphs, n, n); -1 where there is no path."""
        out, reach = np.full((self.count, self.n, self.n), -1, np.int64), np.zeros((self.count, self.n), np.int64)
        new = np.broadcast_to(1 << np.arange(self.n), (self.count, self.n)).copy()
        for d in range(self.n):
            out = np.where((new[:, :, None] >> np.arange(self.n) & 1) == 1, d, out)
            reach |= new
            new = self._at(self.near, reach) & ~reach
        return out

    @cached_property
    def automorphisms(self) -> np.ndarray:
        """Partial maps of the first vertices that keep adjacency, one vertex at a time."""
        graph, image = np.arange(self.count), np.empty((self.count, 0), np.int64)
        for k in range(self.n):
            fits = self.degrees[graph] == self.degrees[graph, k][:, None]
            for j in range(k):
                fits &= self.matrix[graph, image[:, j]] == self.matrix[graph, j, k][:, None]
                fits[np.arange(len(graph)), image[:, j]] = False
            row, w = np.nonzero(fits)
            graph, image = graph[row], np.column_stack([image[row], w])
        return np.bincount(graph, minlength=self.count)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Separated pairs of chordless odd cycles: graph, mask, mask; no edge joins the two."""
        graph, mask = np.nonzero(self.induced & (self.pc % 2 == 1))
        closed = mask | self.near[graph, mask]
        g, a, b, step = [graph[:0]], [mask[:0]], [mask[:0]], 1
        while step < len(graph):
            same = graph[step:] == graph[:-step]
            if not same.any():
                break
            at = np.flatnonzero(same & (closed[:-step] & mask[step:] == 0))
            g.append(graph[at])
            a.append(mask[at])
            b.append(mask[at + step])
            step += 1
        return np.concatenate(g), np.concatenate(a), np.concatenate(b)

    @cached_property
    def occ_witness(self) -> tuple[np.ndarray, np.ndarray]:
        """The smallest S (by size, then as a number) such that neither S nor what is outside its closed
        neighbourhood is bipartite, and that outside; -1 where there is none."""
        outside = self.all & ~(self.near | self.sets)
        bad = self.nonbipartite & self._at(self.nonbipartite, outside)
        rank = np.where(bad, self.pc * self.size + self.sets, self.size * (self.n + 1))
        s = rank.argmin(axis=1)
        found = bad[np.arange(self.count), s]
        return np.where(found, s, -1), np.where(found, outside[np.arange(self.count), s], -1)


def _extreme(values: np.ndarray, ok: np.ndarray, biggest: bool = False) -> np.ndarray:
    """Least (or greatest) of the values that are ok in each row, NaN without any."""
    bad = -np.inf if biggest else np.inf
    x = np.where(ok, values, bad)
    x = x.max(axis=1) if biggest else x.min(axis=1)
    return np.where(np.isfinite(x), x, np.nan)


def _basic(k: Lattice) -> dict:
    n, d = k.n, k.degrees
    out = {"n": np.full(k.count, n), "m": k.m, "m_minus_n": k.m - n, "density": 2 * k.m / (n * (n - 1))}
    out |= {"deg_min": d.min(axis=1), "deg_max": d.max(axis=1), "deg_mean": d.mean(axis=1), "deg_std": d.std(axis=1)}
    out |= {f"deg_count_{c}": (d == c).sum(axis=1) for c in (2, 3, 4)} | {"deg_count_5plus": (d >= 5).sum(axis=1), "frac_deg_2": (d == 2).sum(axis=1) / n}
    return out


def _threads(k: Lattice) -> dict:
    rest = ((k.degrees == 2) << np.arange(k.n)).sum(axis=1)
    count, longest = k.components[np.arange(k.count), rest], np.zeros(k.count, np.int64)
    for _ in range(k.n):
        part = k.component[np.arange(k.count), rest]
        longest = np.maximum(longest, np.where(rest > 0, np.bitwise_count(part) + 1, 0))
        rest = rest ^ part
    return {"n_threads": count, "thread_max_len": longest}


def _triangles(k: Lattice) -> dict:
    a = k.matrix
    at = np.einsum("bij,bjk,bki->bi", a, a, a) // 2
    d = k.degrees
    wedges = d * (d - 1) // 2
    local = np.where(d >= 2, at / np.maximum(wedges, 1), 0.0)
    total = wedges.sum(axis=1)
    return {"n_triangles": at.sum(axis=1) // 3, "avg_clustering": local.mean(axis=1), "transitivity": np.where(total > 0, at.sum(axis=1) / np.maximum(total, 1), 0.0)}


def _cycles(k: Lattice) -> dict:
    c, odd = k.cycles, k.pc % 2 == 1
    out = {f"cyc_len_{length}": c[:, k.pc == length].sum(axis=1) for length in CYCLE_LENGTHS}
    out |= {"n_odd_cycles": c[:, odd].sum(axis=1), "n_even_cycles": c[:, ~odd].sum(axis=1)}
    return out | {"girth": _extreme(k.pc, c > 0), "odd_girth": _extreme(k.pc, (c > 0) & odd), "even_girth": _extreme(k.pc, (c > 0) & ~odd)}


def _chordless(k: Lattice) -> dict:
    out = {f"chordless_len_{length}": k.induced[:, k.pc == length].sum(axis=1) for length in CYCLE_LENGTHS}
    return out | {"n_chordless_even_cycles": k.induced[:, k.pc % 2 == 0].sum(axis=1), "n_chordless_odd_cycles": k.induced[:, k.pc % 2 == 1].sum(axis=1)}


def _connectivity(k: Lattice) -> dict:
    apart = _extreme(k.n - k.pc, ~k.connected & (k.pc >= 2))
    cut = k.m[:, None] - k.edges - k.edges[:, k.all ^ k.sets]
    proper = (k.sets > 0) & (k.sets < k.all)
    return {"node_connectivity": np.where(np.isnan(apart), k.n - 1, apart).astype(np.int64), "edge_connectivity": cut[:, proper].min(axis=1)}


def _blocks(k: Lattice) -> dict:
    less = np.stack([k.components[:, k.all ^ 1 << v] for v in range(k.n)], axis=1)
    return {
        "n_cut_vertices": (less > k.components[:, k.all, None]).sum(axis=1), "n_bridges": k.blocks[:, k.pc == 2].sum(axis=1),
        "n_blocks": k.blocks.sum(axis=1), "n_nonbipartite_blocks": (k.blocks & k.nonbipartite).sum(axis=1),
    }


def _distances(k: Lattice) -> dict:
    whole = k.connected[:, k.all]
    far = k.distance.max(axis=2)
    null = lambda x: np.where(whole, x, np.nan)
    return {"diameter": null(far.max(axis=1)), "radius": null(far.min(axis=1)), "avg_shortest_path": null(k.distance.sum(axis=(1, 2)) / (k.n * (k.n - 1)))}


def _spectra(k: Lattice) -> dict:
    a = k.matrix.astype(np.float64)
    d = np.eye(k.n) * a.sum(axis=2)[:, None, :]
    adj, lap, sign = (np.linalg.eigvalsh(x) for x in (a, d - a, d + a))
    rounded = lambda x: [np.round(row, 6) + 0.0 for row in x]
    return {
        "adj_eig_max": adj[:, -1], "adj_eig_min": adj[:, 0], "adj_eig_2nd": adj[:, -2], "adj_energy": np.abs(adj).sum(axis=1),
        "lap_algebraic_connectivity": lap[:, 1], "lap_eig_max": lap[:, -1], "signless_lap_min": sign[:, 0],
        "n_spanning_trees": np.round(np.prod(lap[:, 1:], axis=1) / k.n).astype(np.int64), "adj_spectrum": rounded(adj), "lap_spectrum": rounded(lap),
    }


def _parity(k: Lattice) -> dict:
    cut = (k.m[:, None] - k.edges - k.edges[:, k.all ^ k.sets]).max(axis=1)
    return {"odd_cycle_transversal": k.n - np.where(~k.nonbipartite, k.pc, 0).max(axis=1), "edge_frustration": k.m - cut}


def _pairs(k: Lattice) -> dict:
    g, a, b = k.pairs
    count = lambda ok=None: np.bincount(g if ok is None else g[ok], minlength=k.count)
    la, lb = k.pc[a], k.pc[b]
    short, long_ = np.minimum(la, lb), np.maximum(la, lb)
    three, five = (short == 3) & (long_ == 3), (short == 3) & (long_ == 5)
    union = np.unique(np.stack([g, a | b]), axis=1)
    out = {"sep_pairs": count(), "sep_pairs_3_3": count(three), "sep_pairs_3_5": count(five), "sep_pairs_other": count(~three & ~five), "normalization_gap": np.bincount(union[0], minlength=k.count)}
    # even cycles that meet both members of some pair, each once
    meets = np.zeros((k.count, k.size), bool)
    distance, paths, linkage = np.empty(len(g), np.int64), np.empty(len(g), np.int64), np.empty(len(g), np.int64)
    powers = [np.broadcast_to(np.eye(k.n, dtype=np.int64), k.matrix.shape)]
    while len(powers) < k.n:
        powers.append(powers[-1] @ k.matrix)
    powers = np.stack(powers, axis=1)
    inside = k.sets[:, None] >> np.arange(k.n) & 1
    for at in range(0, len(g), 256):
        s = slice(at, at + 256)
        gs, aa, bb = g[s], a[s, None], b[s, None]
        np.logical_or.at(meets, gs, (k.sets & aa > 0) & (k.sets & bb > 0))
        walks = np.einsum("pi,pdij,pj->pd", inside[a[s]], powers[gs], inside[b[s]])
        first = (walks > 0).argmax(axis=1)
        joined = walks[np.arange(len(gs)), first] > 0
        distance[s], paths[s] = np.where(joined, first, -1), walks[np.arange(len(gs)), first] * joined
        cut = np.bitwise_count((aa | k.sets | k.near[gs]) & ~k.sets).astype(np.int64)
        linkage[s] = np.where(k.sets & bb == 0, cut, k.n).min(axis=1)
    even = np.where(meets & (k.pc % 2 == 0), k.cycles, 0)
    out |= {"even_cycles_meeting_pair": even.sum(axis=1), "even_cycle_meets_pair": (even > 0).any(axis=1).astype(np.int64), "even_meeting_len_min": _extreme(k.pc, even > 0)}
    out["sep_same_block_pairs"] = count(linkage >= 2)

    def reduced(values: np.ndarray, biggest: bool, keep: np.ndarray | None = None) -> np.ndarray:
        x = np.full(k.count, -np.inf if biggest else np.inf)
        keep = slice(None) if keep is None else keep
        (np.maximum if biggest else np.minimum).at(x, g[keep], values[keep].astype(np.float64))
        return np.where(np.isfinite(x), x, np.nan)

    least = reduced(distance, False)
    walk, total = (la + lb) // 2 + distance, la + lb
    out |= {"sep_dist_min": least, "sep_dist_max": reduced(distance, True), "sep_closest_geodesics": reduced(paths, True, distance == least[g])}
    for name, values in (("sep_linkage", linkage), ("sep_walk_degree", walk), ("sep_len_sum", total)):
        out |= {f"{name}_min": reduced(values, False), f"{name}_max": reduced(values, True)}
    return out


def _standard(k: Lattice) -> dict:
    return {"independence_number": np.where(k.edges == 0, k.pc, 0).max(axis=1), "matching_number": k.matching[:, k.all], "chromatic_number": k.chromatic}


def _occ(k: Lattice) -> dict:
    s, t = k.occ_witness
    return {"fails_occ": (s >= 0).astype(np.int64), "occ_s": np.where(s >= 0, s, np.nan), "occ_t": np.where(s >= 0, t, np.nan)}


#: Columns by the function that computes them, in the order of a feature row.
GROUPS = {
    _basic: ["n", "m", "m_minus_n", "density", "deg_min", "deg_max", "deg_mean", "deg_std", "deg_count_2", "deg_count_3", "deg_count_4", "deg_count_5plus", "frac_deg_2"],
    _threads: ["n_threads", "thread_max_len"],
    _triangles: ["n_triangles", "avg_clustering", "transitivity"],
    _cycles: [*[f"cyc_len_{c}" for c in CYCLE_LENGTHS], "n_odd_cycles", "n_even_cycles", "girth", "odd_girth", "even_girth"],
    _chordless: [*[f"chordless_len_{c}" for c in CYCLE_LENGTHS], "n_chordless_even_cycles", "n_chordless_odd_cycles"],
    _connectivity: ["node_connectivity", "edge_connectivity"],
    _blocks: ["n_cut_vertices", "n_bridges", "n_blocks", "n_nonbipartite_blocks"],
    _distances: ["diameter", "radius", "avg_shortest_path"],
    _spectra: ["adj_eig_max", "adj_eig_min", "adj_eig_2nd", "adj_energy", "lap_algebraic_connectivity", "lap_eig_max", "signless_lap_min", "n_spanning_trees", "adj_spectrum", "lap_spectrum"],
    lambda k: {"aut_group_size": k.automorphisms}: ["aut_group_size"],
    _parity: ["odd_cycle_transversal", "edge_frustration"],
    _pairs: [
        "sep_pairs", "sep_pairs_3_3", "sep_pairs_3_5", "sep_pairs_other", "normalization_gap", "sep_same_block_pairs", "even_cycles_meeting_pair", "even_cycle_meets_pair", "even_meeting_len_min",
        "sep_dist_min", "sep_dist_max", "sep_closest_geodesics", "sep_linkage_min", "sep_linkage_max", "sep_walk_degree_min", "sep_walk_degree_max", "sep_len_sum_min", "sep_len_sum_max",
    ],
    _standard: ["independence_number", "matching_number", "chromatic_number"],
    lambda k: {"treewidth": k.treewidth}: ["treewidth"],
    lambda k: {"is_hamiltonian": (k.cycles[:, k.all] > 0).astype(np.int64)}: ["is_hamiltonian"],
    lambda k: {"n_components": k.components[:, k.all]}: ["n_components"],
    lambda k: {"is_nonbipartite": k.nonbipartite[:, k.all].astype(np.int64)}: ["is_nonbipartite"],
    _occ: ["fails_occ", "occ_s", "occ_t"],
}
DOUBLES = {"density", "deg_mean", "deg_std", "frac_deg_2", "avg_clustering", "transitivity", "avg_shortest_path", "adj_eig_max", "adj_eig_min", "adj_eig_2nd", "adj_energy", "lap_algebraic_connectivity", "lap_eig_max", "signless_lap_min"}
LISTS = {"adj_spectrum", "lap_spectrum"}
COLUMNS = [c for own in GROUPS.values() for c in own]


def compute(adj: np.ndarray, wanted: list[str]) -> dict[str, np.ndarray | list]:
    """The wanted columns of graphs with the same number of vertices; a missing value is NaN."""
    lattice, out = Lattice(adj), {}
    for make, own in GROUPS.items():
        if set(own) & set(wanted):
            out |= make(lattice)
    return {c: out[c] for c in wanted}
