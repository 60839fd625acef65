"""Ratcliff/Obershelp similarity and best-first search over a bounded list of aliases.

The ratio of two strings never exceeds their multiset bound, 2 * common characters / total length,
and containing pairs reach it. A query's aliases are visited in falling order of the bound and the
search ends once the bound cannot enter the current best ones; those that remain must pass the bound
of their longest common subsequence, so few ratios are computed.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

from moorline.options import CONTAINED, FUZZY_FLOOR


def ratio(query: str, alias: str) -> float:
    """Not symmetric: the query comes first."""
    return SequenceMatcher(a=query, b=alias).ratio() if query and alias else 0.0


def common_subsequence(masks: dict[str, int], length: int, alias: str) -> int:
    """Length of the longest common subsequence of alias and a query, from the query's places of each
    character as bits: a machine word of places moves at once."""
    full = (1 << length) - 1
    free = full
    for c in alias:
        met = free & masks.get(c, 0)
        free = ((free + met) | (free - met)) & full
    return length - free.bit_count()


def places(query: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(query):
        out[c] = out.get(c, 0) | 1 << i
    return out


class AliasMatcher:
    """Best entities for query strings, from (entity_ord, alias_ord, raw alias, normalised alias)."""

    def __init__(self, rows: list[tuple[int, int, str, str]]):
        rows = sorted(r for r in rows if r[3])
        self.entity = np.array([r[0] for r in rows], np.int64)
        self.raw, self.norm = [r[2] for r in rows], [r[3] for r in rows]
        self.length = np.array([len(x) for x in self.norm], np.int64)
        alphabet = sorted({c for x in self.norm for c in x})
        self.column = {c: k for k, c in enumerate(alphabet)}
        self.counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.matchers: dict[int, SequenceMatcher] = {}
        held: dict[str, dict[int, int]] = {}
        for i, x in enumerate(self.norm):
            for c in x:
                of = held.setdefault(c, {})
                of[i] = of.get(i, 0) + 1
        for c, of in held.items():
            self.counts[c] = (np.fromiter(of.keys(), np.int64), np.fromiter(of.values(), np.int64))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"matchers": {}}

    def common(self, query: str) -> np.ndarray:
        """Characters that the query shares with each alias, as multisets."""
        out = np.zeros(len(self.norm), np.int64)
        for c in set(query):
            if c in self.counts:
                rows, times = self.counts[c]
                out[rows] += np.minimum(times, query.count(c))
        return out

    def ratio(self, query: str, i: int) -> float:
        """As `ratio`, the alias prepared once."""
        if i not in self.matchers:
            self.matchers[i] = SequenceMatcher(b=self.norm[i])
        self.matchers[i].set_seq1(query)
        return self.matchers[i].ratio()

    def best(self, queries: list[str], keep: int) -> list[tuple[int, float, str]]:
        """(entity_ord, similarity, raw alias) of the `keep` best entities, best rounded score first,
        then entity order; per entity the first alias of the greatest similarity."""
        queries = [q for q in queries if q]
        if not len(self.norm) or not queries:
            return []
        bound, contained = np.zeros(len(self.norm)), np.zeros(len(self.norm), bool)
        for q in queries:
            common = self.common(q)
            # The same quotient as the ratio of a fully matching pair.
            bound = np.maximum(bound, 2.0 * common / (self.length + len(q)))
            if len(q) >= 2:  # containment needs all characters of the shorter one, so few pairs are looked at
                for i in np.flatnonzero(common == np.minimum(self.length, len(q))).tolist():
                    contained[i] |= q in self.norm[i] or self.norm[i] in q
        bound[contained] = np.maximum(bound[contained], CONTAINED)
        some = np.flatnonzero(bound >= FUZZY_FLOOR)
        order = some[np.argsort(-bound[some], kind="stable")]
        found: dict[int, tuple[float, int]] = {}
        worst = 0.0
        masks = [(q, places(q)) for q in queries]
        for i in order.tolist():
            top = bound[i]
            if len(found) >= keep and round(min(float(top), 1.0), 3) < worst:
                break
            # Matching blocks are a common subsequence: a tighter bound that is cheaper than matching.
            alias = self.norm[i]
            tight = max(2.0 * common_subsequence(m, len(q), alias) / (len(alias) + len(q)) for q, m in masks)
            if contained[i]:
                tight = max(tight, CONTAINED)
            if tight < FUZZY_FLOOR or (len(found) >= keep and round(min(tight, 1.0), 3) < worst):
                continue
            score = max(self.ratio(q, i) for q in queries)
            if contained[i]:
                score = max(score, CONTAINED)
            e = int(self.entity[i])
            if score >= FUZZY_FLOOR and (e not in found or (score, -i) > (found[e][0], -found[e][1])):
                found[e] = (score, i)
                if len(found) >= keep:
                    worst = sorted((round(min(s, 1.0), 3) for s, _ in found.values()), reverse=True)[keep - 1]
        ranked = sorted(found.items(), key=lambda kv: (-round(min(kv[1][0], 1.0), 3), kv[0]))[:keep]
        return [(e, s, self.raw[i]) for e, (s, i) in ranked]
