"""All terms of an index within a phonetic bound of each query, by walking a trie of their phonemes.

Readings with a common beginning share its nodes, so the rows of their edit matrices are computed once. A node is a phoneme
with its cost of insertion (which depends on the phoneme after it, so the trie parts one phoneme early where that differs); its row holds
the least cost of each beginning of the query against the beginning of the terms below it. A branch is left once its row's
least entry is over what any term below may cost, or no term below has a length or morae that the bounds allow. Many queries and
nodes go down together: a step is a few numpy passes over the pairs that are still open, a row's entry at a time.

The walk runs in single precision with a margin; what it finds is measured again in double precision, so results are those of
comparing every pair."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from echolex.functions import distance_batch as D
from echolex.functions.cost_model import CostModel

MARGIN = 1e-3
PAIRS = 1 << 16  # open pairs of a step
TOGETHER = 64  # queries that go down together
STEPS = (0.3, 0.6, 1.0)  # of the bound, one after another
SLACK = 1e-9  # beyond a part of the bound, relative: what is as near as its last one, but for rounding, is met too
NONE = np.iinfo(np.int64).max


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``begin`` to ``begin + count`` of each row, one after another."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))


def numbered(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Phonemes as numbers, (rows, longest), and lengths."""
    return D._padded(column, True)


@dataclass
class Trie:
    """Nodes by depth; the children of a node, and the readings that end there, are runs of numbers."""

    model: CostModel
    readings: pa.Table  # phonemes, indel, morae, group (equal: one entry), order (rank among equally near ones), and others
    symbol: np.ndarray
    cost: np.ndarray
    child: np.ndarray  # first child
    children: np.ndarray
    ends: np.ndarray  # first place in ``slots``
    ending: np.ndarray
    slots: np.ndarray
    shortest: np.ndarray  # lengths and morae of the terms at and below a node
    longest: np.ndarray
    least_morae: np.ndarray
    most_morae: np.ndarray

    @staticmethod
    def build(readings: pa.Table, model: CostModel) -> Trie:
        readings = readings.combine_chunks()
        phonemes, size = numbered(readings.column("phonemes"))
        costs, _ = D._padded(readings.column("indel"), False)
        morae = readings.column("morae").to_numpy().astype(np.int64)
        known = np.unique(costs)
        key = phonemes * len(known) + np.searchsorted(known, costs)  # a phoneme with its cost
        n, wide = key.shape
        key = np.where(np.arange(wide)[None, :] < size[:, None], key, -1)
        order = np.lexsort([key[:, i] for i in range(wide - 1, -1, -1)]) if wide else np.arange(n)
        key, own, length = key[order], np.zeros(n, np.int64), size[order]
        symbol, cost, child, children, parent = [0], [0.0], [], [], [np.zeros(0, np.int64)]
        end_of, count = np.zeros(n, np.int64), 1
        level = np.zeros(1, np.int64)  # the nodes of this depth
        for i in range(wide + 1):
            end_of[length == i] = own[length == i]
            live = np.flatnonzero(length > i)
            if not len(live):
                child += [count] * len(level)
                children += [0] * len(level)
                break
            new = np.ones(len(live), bool)
            new[1:] = (own[live[1:]] != own[live[:-1]]) | (key[live[1:], i] != key[live[:-1], i])
            above, what = own[live[new]], key[live[new], i]
            many = np.bincount(above - level[0], minlength=len(level))
            children += many.tolist()
            child += (count + np.concatenate([[0], np.cumsum(many)[:-1]])).tolist()
            own[live] = count + np.cumsum(new) - 1
            level = np.arange(count, count + len(what))
            symbol += (what // len(known)).tolist()
            cost += known[what % len(known)].tolist()
            parent.append(above)
            count += len(what)
        low, high, few, most = np.full(count, NONE), np.full(count, -1), np.full(count, NONE), np.full(count, -1)
        for at, value, take in ((low, length, np.minimum), (high, length, np.maximum), (few, morae[order], np.minimum), (most, morae[order], np.maximum)):
            take.at(at, end_of, value)
        for at, take in ((low, np.minimum), (high, np.maximum), (few, np.minimum), (most, np.maximum)):
            stop = count
            for nodes in reversed(parent[1:]):  # from the deepest up
                take.at(at, nodes, at[stop - len(nodes) : stop])
                stop -= len(nodes)
        place = np.argsort(end_of, kind="stable")
        ending = np.bincount(end_of, minlength=count)
        whole = lambda x, kind: np.asarray(x, kind)
        return Trie(
            model, readings, whole(symbol, np.int64), whole(cost, np.float32), whole(child, np.int64), whole(children, np.int64), np.concatenate([[0], np.cumsum(ending)[:-1]]), ending, order[place], low, high, few, most,
        )

    def walk(self, phonemes: np.ndarray, size: np.ndarray, indel: np.ndarray, morae: np.ndarray, tau: np.ndarray, most: np.ndarray, ratio: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, reading) of pairs that may be within bounds, of queries with phonemes; ``most``: of the cost, infinite for none."""
        n, wide = phonemes.shape
        outside = np.arange(wide)[None, :] >= size[:, None]
        costs = D.substitutions(self.model).astype(np.float32)
        # a query's costs of each symbol at each place, and of leaving a place out: infinite beyond its end
        swap = np.ascontiguousarray(np.where(outside[:, :, None], np.inf, costs[phonemes]).transpose(1, 0, 2)).astype(np.float32).reshape(wide, -1)
        skip = np.where(outside, np.inf, indel).astype(np.float32).T.copy()
        kinds = len(costs)
        least, slots, whom = np.float32(self.model.least_indel), [], []
        start = np.zeros((wide + 1, n), np.float32)
        np.cumsum(skip, axis=0, out=start[1:])
        stack = [(np.arange(n), np.zeros(n, np.int64), start)]
        while stack:
            q, node, row = stack.pop()
            ended = np.flatnonzero(self.ending[node])
            if len(ended):
                own, who = node[ended], q[ended]
                # what ends at a node is the shortest at and below it
                done = row[size[who], ended] <= np.minimum(tau[who] * np.maximum(size[who], self.shortest[own]), most[who]) + MARGIN
                own, who = own[done], who[done]
                slots.append(self.slots[_ragged(self.ends[own], self.ending[own])])
                whom.append(np.repeat(who, self.ending[own]))
            many = self.children[node]
            up = np.repeat(np.arange(len(node)), many)
            if not len(up):
                continue
            node, q = _ragged(self.child[node], many), q[up]
            low, high = self.shortest[node], self.longest[node]
            # some length below must be within reach: the nearest one to the query's
            near = np.clip(size[q], low, high)
            reach = np.abs(near - size[q]) * least <= tau[q] * np.maximum(size[q], near) + MARGIN
            if ratio is not None:
                at = np.clip(morae[q], self.least_morae[node], self.most_morae[node])
                reach &= (np.abs(at - morae[q]) <= (ratio + 1e-6) * np.maximum(at, morae[q])) | (morae[q] == 0) | (self.least_morae[node] == 0)
            up, node, q, high = up[reach], node[reach], q[reach], high[reach]
            budget = np.minimum(tau[q] * np.maximum(size[q], high), most[q]) + MARGIN
            for a in range(0, len(up), PAIRS):
                part = slice(a, a + PAIRS)
                who, cost, old = q[part], self.cost[node[part]], row[:, up[part]]
                place = who * kinds + self.symbol[node[part]]
                new = np.empty_like(old)
                np.add(old[0], cost, out=new[0])
                lowest = new[0].copy()
                for i in range(wide):
                    cell = np.minimum(old[i + 1] + cost, old[i] + swap[i].take(place))
                    np.minimum(cell, new[i] + skip[i].take(who), out=new[i + 1])
                    np.minimum(lowest, new[i + 1], out=lowest)
                go = np.flatnonzero(lowest <= budget[part])
                if len(go):
                    stack.append((who[go], node[part][go], new[:, go]))
        if not slots:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(whom), np.concatenate(slots)

    def nearest(self, asked: pa.Table, top_k: int, ratio: float | None) -> pa.Table:
        """query (its place in ``asked``), rank, slot, raw, nd of the ``top_k`` nearest entries, each by its nearest reading.

        ``asked``: phonemes, indel, morae, tau, max_raw (null: none). A bound that many terms meet is widened step by step:
        a query that has its ``top_k`` within a part of the bound needs no more."""
        rest, found = np.arange(asked.num_rows), []
        _, size = numbered(asked.column("phonemes"))
        tau = asked.column("tau").to_numpy()
        whole, most = tau * size, asked.column("max_raw").to_numpy(zero_copy_only=False).astype(np.float64)
        for share in STEPS:
            short = []
            for a in range(0, len(rest), TOGETHER):
                at = rest[a : a + TOGETHER]
                who, place, slot, raw, nd = self._within(asked.take(pa.array(at)), share, top_k, ratio)
                # where the bound on the cost itself is the tighter one already, a wider share finds no more
                enough = (np.bincount(who[nd <= share * tau[at[who]]], minlength=len(at)) >= top_k) | (share * whole[at] >= most[at]) | (share == 1)
                keep = enough[who]
                found.append((at[who[keep]], place[keep], slot[keep], raw[keep], nd[keep]))
                short.append(at[~enough])
            rest = np.concatenate(short) if short else rest
        kinds = [f.type for f in _RANKED]
        return pa.table([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], schema=_RANKED) if found else _RANKED.empty_table()

    def _within(self, asked: pa.Table, share: float, top_k: int, ratio: float | None) -> tuple[np.ndarray, ...]:
        asked = asked.combine_chunks()
        (phonemes, size), (indel, _) = numbered(asked.column("phonemes")), D._padded(asked.column("indel"), False)
        morae = asked.column("morae").to_numpy().astype(np.int64)
        tau, most = (asked.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("tau", "max_raw"))
        most = np.where(np.isnan(most), np.inf, most)
        part = tau if share == 1 else tau * share * (1 + SLACK)
        who, slot = self.walk(phonemes, size, indel, morae, part, most, ratio)
        theirs = self.readings.take(pa.array(slot))
        _, length = numbered(theirs.column("phonemes"))
        if ratio is not None:
            other = theirs.column("morae").to_numpy().astype(np.int64)
            larger = np.maximum(morae[who], other)
            fits = (morae[who] == 0) | (other == 0) | (np.abs(morae[who] - other) / np.maximum(larger, 1) <= ratio + 1e-9)
            who, slot, length, theirs = who[fits], slot[fits], length[fits], theirs.filter(pa.array(fits))
        norm = np.maximum(1, np.maximum(size[who], length))
        column = lambda t, c: t.column(c).combine_chunks()
        mine = asked.take(pa.array(who))
        budget = pa.array(np.minimum(np.minimum(part, tau)[who] * norm, most[who]), pa.float64())
        raw = D.distances(column(mine, "phonemes"), column(theirs, "phonemes"), column(mine, "indel"), column(theirs, "indel"), budget, self.model).to_numpy(zero_copy_only=False)
        good = ~np.isnan(raw)
        who, slot, raw, nd = who[good], slot[good], raw[good], raw[good] / norm[good]
        group, rank = (self.readings.column(c).to_numpy()[slot] for c in ("group", "order"))
        turn = np.lexsort((slot, nd, group, who))
        new = np.ones(len(turn), bool)
        new[1:] = (who[turn[1:]] != who[turn[:-1]]) | (group[turn[1:]] != group[turn[:-1]])
        best = turn[new]
        best = best[np.lexsort((rank[best], nd[best], who[best]))]
        place = np.arange(len(best)) - np.searchsorted(who[best], who[best])
        best, place = best[place < top_k], place[place < top_k]
        return who[best], (place + 1).astype(np.int32), slot[best], raw[best], nd[best]


#: Of ``nearest``.
_RANKED = pa.schema([("query", pa.int64()), ("rank", pa.int32()), ("slot", pa.int64()), ("raw", pa.float64()), ("nd", pa.float64())])
