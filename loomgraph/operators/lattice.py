"""Best paths through the word lattices of many texts at once: a trie in one hash table, and one step a byte for all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are cut at once and that are passed on at once, bytes from which a text is cut in pieces, and those before a piece at which it starts anew.
BLOCK, PASSED, CHUNK, WARM = 512_000, 8_000_000, 768, 256
#: Cost of what no path reaches, the byte after a piece, nodes of a trie with a plain table, and a factor that spreads keys.
FAR, END, NEAR, SPREAD = 1 << 60, 256, 8192, np.uint64(0x9E3779B97F4A7C15)
#: Bytes of the character that starts with a byte; 0 inside of one.
_SIZE = np.repeat(np.array([1, 0, 2, 3, 4], np.int64), [128, 64, 32, 16, 16])


class Lattice:
    """``words`` (word: its tags and costs), ``moves`` and costs as ``language.Segmenter`` has them, packed for arrays. The trie is
    one hash table: ``keys`` are a node and a byte, ``nodes`` the child there."""

    def __init__(self, words: dict[str, list[tuple[str, int]]], moves: dict[tuple[str, str], int], unknown: int, unseen: int, other: str, start: str):
        self.tags = sorted({other, *(t for told in words.values() for t, _ in told)})
        self.other, self.shift = self.tags.index(other), max(1, len(self.tags).bit_length())
        # a cost's lowest bits are the tag before, so that of equal costs the least tag is the minimum
        self.moves = np.array([[(moves.get((a, b), unseen) << self.shift) | k for b in self.tags] for k, a in enumerate(self.tags)], np.int64)
        self.first = np.array([moves.get((start, b), unseen) << self.shift for b in self.tags], np.int64)
        # of a character as it is and as a word of the same tag only the cheaper one is an edge, the word if they are equal
        entries = [(w.encode(), sorted((self.tags.index(t), c << self.shift) for t, c in told if len(w) > 1 or t != other or c <= unknown)) for w, told in words.items() if w]
        self.longest = max((len(w) for w, _ in entries), default=0)
        self.counts = np.array([len(told) for _, told in entries], np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.tag_of = np.array([t for _, told in entries for t, _ in told], np.int64)
        self.cost_of = np.array([c for _, told in entries for _, c in told], np.int64)
        self.size_of = np.repeat(np.array([len(w) for w, _ in entries], np.int64), self.counts)
        self.plain = np.repeat(np.array([len(w.decode()) == 1 for w, _ in entries], bool), self.counts) & (self.tag_of == self.other)
        # the last entries are characters of one to four bytes that no word covers
        self.n_known = len(self.tag_of)
        self.tag_of, self.cost_of, self.size_of = (np.append(x, y) for x, y in ((self.tag_of, [self.other] * 4), (self.cost_of, [unknown << self.shift] * 4), (self.size_of, [1, 2, 3, 4])))
        self._pack([w for w, _ in entries])

    def _pack(self, words: list[bytes]) -> None:
        lengths = np.array([len(w) for w in words], np.int64)
        data, begins = np.frombuffer(b"".join(words) or b"\0", np.uint8), np.cumsum(lengths) - lengths
        state, live, found, nodes = np.zeros(len(words), np.int64), np.arange(len(words)), [np.empty(0, np.int64)], 1
        for depth in range(self.longest):
            live = live[lengths[live] > depth]
            keys, which = np.unique((state[live] << 9) | data[begins[live] + depth], return_inverse=True)
            state[live] = nodes + which
            found.append(keys)
            nodes += len(keys)
        self.word_at = np.full(nodes, -1, np.int32)
        self.word_at[state] = np.arange(len(words))
        self.bits = max(4, (2 * nodes).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys = np.concatenate(found)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
        self.nodes[slots] = np.arange(1, nodes)
        # the nodes of the first levels, which most steps start from, have their children in a plain table
        parents, self.near = keys >> 9, np.zeros((min(nodes, NEAR), END + 1), np.int32)
        first = np.flatnonzero(parents < len(self.near))
        self.near[parents[first], keys[first] & 511] = first + 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).view(np.int64)

    def _children(self, nodes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``nodes`` that have a child by their byte of ``data``, and the children."""
        if len(nodes) and nodes.max() < len(self.near):
            child = self.near.ravel().take(nodes * (END + 1) + data)
            at = np.flatnonzero(child)
            return at, child[at].astype(np.int64)
        keys = (nodes << 9) | data
        slots = self._slots(keys)
        seen = self.keys.take(slots)
        hit = seen == keys
        left = np.flatnonzero(~hit & (seen >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            seen = self.keys[slots[left]]
            hit[left] = same = seen == keys[left]
            left = left[~same & (seen >= 0)]
        at = np.flatnonzero(hit)
        return at, self.nodes[slots[at]].astype(np.int64)

    def cut(self, data: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK, warm: int = WARM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of the texts ``data[bounds[k]:bounds[k + 1]]`` (UTF-8) begin, in order, their tags (places in ``tags``) and
        whether they are known; neighbouring characters that no word covers are one word.

        Long texts are cut in pieces, each of which starts some bytes before its place at any tag. Costs that, about its place, differ
        from those of the piece before by the same number at all nodes that words across it come from differ so ever after, and
        paths don't differ at all. Where they don't, the text is cut again in longer pieces, at last as a whole."""
        marks = np.zeros(len(data) + 1, np.int16)
        texts = np.flatnonzero(np.diff(bounds))
        warm = max(warm, self.longest, 4)
        while len(texts):
            # texts of about one length side by side: a block takes as many steps as its longest piece has bytes
            lengths = bounds[texts + 1] - bounds[texts]
            order = np.argsort(lengths, kind="stable")
            parts = [texts[order[low:high]] for low, high in blocks(np.concatenate([[0], np.cumsum(lengths[order])]))]
            texts = np.concatenate([self._mark(data, bounds[t], bounds[t + 1], t, max(chunk, 3 * warm), warm, marks) for t in parts])
            chunk, warm = chunk * 2, warm * 2
        at = np.flatnonzero(marks)
        tags, known = (marks[at] - 1) >> 1, (marks[at] & 1) == 1
        inner = np.zeros(len(at), bool)
        inner[1:] = ~known[1:] & ~known[:-1]
        inner &= ~np.isin(at, bounds)
        return at[~inner], tags[~inner], known[~inner]

    def _mark(self, data, begins, ends, names, chunk, warm, marks) -> np.ndarray:
        """Sets ``marks`` at each word's first byte; returns those of ``names`` whose pieces don't fit."""
        n_tags, shift = len(self.tags), self.shift
        # pieces: bytes from ``a`` on, of their own from ``own`` on, up to ``z``; the longest first
        pieces = -((begins - ends) // chunk)
        text = np.repeat(np.arange(len(begins)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own, z = (begins[text] + (ends - begins)[text] * (nth + k) // pieces[text] for k in (0, 1))
        a = np.where(nth > 0, own - warm, own)
        for _ in range(3):
            a = a - ((nth > 0) & (_SIZE[data[a]] == 0))
        order = np.argsort(a - z, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        previous = np.where(nth > 0, rank[np.arange(len(order)) - 1], -1)[order]
        text, own, a, z, nth = text[order], own[order], a[order], z[order], nth[order]
        length, ahead = z - a, own - a

        # nodes: (step, piece), all pieces of a step side by side
        steps = int(length[0])
        width = np.searchsorted(-length, -np.arange(steps + 1), side="right")
        off = np.concatenate([[0], np.cumsum(width)])
        step = np.repeat(np.arange(steps + 1), width)
        piece = np.arange(off[-1]) - off[step]
        place = a[piece] + step
        last = step == length[piece]
        byte = np.where(last, END, data[np.minimum(place, len(data) - 1)]).astype(np.int64)
        size = np.where(last, 0, _SIZE[byte & 255])

        # edges (a piece and an entry) by the step at which they begin: words, by a walk down the trie, and characters
        begin, follower = np.flatnonzero(size), np.arange(len(step)) + width[step]
        node, state, told, found = begin, np.zeros(len(begin), np.int64), np.zeros(len(step), bool), []
        step_of = step.astype(np.uint16 if steps < 1 << 16 else np.int64)
        while len(node):
            kept, state = self._children(state, byte.take(node))
            begin, node = begin.take(kept), follower.take(node.take(kept))
            word = self.word_at.take(state)
            hit = np.flatnonzero(word >= 0)
            word, of = word[hit], begin[hit]
            entry, many = self.begins[word], self.counts[word]
            if (many != 1).any():
                of = np.repeat(of, many)
                entry = np.repeat(entry, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            told[of[self.plain[entry]]] = True
            found.append((step_of[of], (piece[of] << 32) | entry))
        single = np.flatnonzero(~told & (size > 0) & (step + size <= length[piece]))
        found.append((step_of[single], (piece[single] << 32) | (self.n_known - 1 + size[single])))
        at, edges = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        edges = edges.take(np.argsort(at, kind="stable"))
        first_edge = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=steps + 1))])

        # the least costs, a step of all pieces at a time; no two edges of a step have one target
        costs, back = np.full(len(step) * n_tags, FAR), np.full(len(step) * n_tags, -1, np.int32)
        before, tables = np.zeros((len(step), n_tags), np.uint8 if n_tags < 256 else np.int32), costs.reshape(-1, n_tags)
        low = (1 << shift) - 1
        tables[: width[0]] = np.where((nth > 0)[: width[0], None], 0, FAR)
        for p in range(steps):
            here = tables[off[p] : off[p + 1]]
            best = here[:, :1] + self.moves[0]
            for k in range(1, n_tags):
                np.minimum(best, here[:, k : k + 1] + self.moves[k], out=best)
            if p == 0:
                best[nth == 0] = self.first
            before[off[p] : off[p + 1]] = best & low
            best &= ~low
            here = edges[first_edge[p] : first_edge[p + 1]]
            entry, r = here & 0xFFFFFFFF, here >> 32
            tag = self.tag_of.take(entry)
            reached = best.ravel().take(r * n_tags + tag) + self.cost_of.take(entry)
            to = (off.take(p + self.size_of.take(entry)) + r) * n_tags + tag
            better = np.flatnonzero(reached <= costs.take(to))
            to = to.take(better)
            costs[to] = reached.take(better)
            back[to] = entry.take(better)

        # pieces against those before them: nodes from the first one that an edge across the place comes from up to the place
        fits = np.ones(len(begins), bool)
        cut = np.flatnonzero(nth > 0)
        if len(cut):
            window = np.repeat(np.arange(steps + 1), np.diff(first_edge))[: first_edge[min(int(ahead.max()), steps) + 1]]
            of, to = edges[: len(window)] >> 32, window + self.size_of[edges[: len(window)] & 0xFFFFFFFF]
            across = np.flatnonzero((ahead[of] > 0) & (window <= ahead[of]) & (to > ahead[of]))
            reach = ahead.copy()
            np.minimum.at(reach, of[across], window[across])
            shifted = np.full(len(nth), FAR)
            for d in range(int((ahead - reach)[cut].max()) + 1):
                r = cut[ahead[cut] - d >= reach[cut]]
                mine, its = tables[off[ahead[r] - d] + r], tables[off[own[r] - d - a[previous[r]]] + previous[r]]
                gap = np.where(mine < FAR, its - mine, FAR)
                same = (mine < FAR) == (its < FAR)
                some = gap.min(axis=1)
                shifted[r] = np.where(shifted[r] == FAR, some, shifted[r])
                same &= (gap == FAR) | (gap == shifted[r][:, None])
                fits[text[r[~same.all(axis=1)]]] = False

        # back along the best paths, a word of all texts at a time
        r = np.flatnonzero((z == ends[text]) & fits[text])
        node = off[length[r]] + r
        now = node * n_tags + tables[node].argmin(axis=1)
        while len(now):
            entry, r = back[now], piece[now // n_tags]
            node, t = off[step[now // n_tags] - self.size_of[entry]] + r, self.tag_of[entry]
            marks[place[node]] = 1 + 2 * t + (entry >= self.n_known)
            t = before[node, t].astype(np.int64)
            kept = np.flatnonzero((step[node] > 0) | (nth[r] > 0))
            node, t, r = node[kept], t[kept], r[kept]
            over = np.flatnonzero((nth[r] > 0) & (step[node] <= ahead[r]))
            its = previous[r[over]]
            node[over] = off[place[node[over]] - a[its]] + its
            now = node * n_tags + t
            now = now[(step[node] > 0) | (nth[piece[node]] > 0)]
        return names[~fits]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of ``size`` bytes, or of one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = to
