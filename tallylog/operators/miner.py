"""Online log-template mining with a fixed-depth tree (He, Zhu, Zheng, Lyu: Drain, ICWS 2017). Plain Python, no Spark.

A message is routed by its token count and its leading tokens to a leaf; among the leaf's clusters the most similar one
takes it, if similar enough, and keeps the positions where they differ as wildcards. Candidates come from an index of
(position, token), so a leaf with thousands of clusters is not searched as a whole: a cluster that shares k of n tokens
shares one of any n - k + 1 positions, so the rarest of those positions list every candidate.
"""

from __future__ import annotations

import math
from collections import OrderedDict, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

WILDCARD = "<*>"


@dataclass(frozen=True)
class MinerConfig:
    similarity: float = 0.56
    depth: int = 4
    max_children: int = 100
    max_clusters: int = 20_000
    #: Search the index of positions; without it every cluster of a leaf is compared.
    indexed: bool = True

    @property
    def routed(self) -> int:
        """Leading tokens that choose the leaf."""
        return max(0, self.depth - 3)


@dataclass(eq=False)
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)
    clusters: dict[int, None] = field(default_factory=dict)  # a set that keeps its order


@dataclass(eq=False)
class _Cluster:
    number: int
    template: tuple[str, ...]
    leaf: _Node


def _numeric(token: str) -> bool:
    return any(c.isdigit() for c in token)


class TemplateMiner:
    def __init__(self, config: MinerConfig | None = None) -> None:
        self.config = config or MinerConfig()
        self.comparisons = 0
        self.evicted = 0
        self.reset()

    def reset(self) -> None:
        self._roots: dict[int, _Node] = {}
        self._live: OrderedDict[int, _Cluster] = OrderedDict()  # least recently used first
        self._at: defaultdict[tuple[int, str], set[int]] = defaultdict(set)
        self._next = 0

    def __len__(self) -> int:
        return len(self._live)

    # -- routing --

    def _find_leaf(self, tokens: tuple[str, ...]) -> _Node | None:
        node = self._roots.get(len(tokens))
        for t in tokens[: self.config.routed]:
            if node is None:
                return None
            node = node.children.get(t) or node.children.get(WILDCARD)
        return node

    def _make_leaf(self, tokens: tuple[str, ...]) -> _Node:
        node = self._roots.setdefault(len(tokens), _Node())
        for t in tokens[: self.config.routed]:
            # The last free place is kept for the wildcard.
            room = self.config.max_children - len(node.children) - (WILDCARD not in node.children)
            own = t in node.children or (not _numeric(t) and room > 0)
            node = node.children.setdefault(t if own else WILDCARD, _Node())
        return node

    # -- matching --

    def _candidates(self, leaf: _Node, tokens: tuple[str, ...], need: int) -> Iterable[int]:
        probes = len(tokens) - need + 1
        if not self.config.indexed or need <= 0 or probes <= 0:
            return list(leaf.clusters)
        lists = sorted((self._at.get((i, t), ()) for i, t in enumerate(tokens)), key=len)
        return sorted({c for numbers in lists[:probes] for c in numbers if c in leaf.clusters})

    def _match(self, tokens: tuple[str, ...]) -> _Cluster | None:
        leaf = self._find_leaf(tokens)
        if leaf is None:
            return None
        if not tokens:
            return next((self._live[c] for c in leaf.clusters), None)
        best, most = None, (-1, -1)
        for number in self._candidates(leaf, tokens, math.ceil(self.config.similarity * len(tokens))):
            template = self._live[number].template
            self.comparisons += 1
            same = sum(a == b for a, b in zip(template, tokens, strict=True) if a != WILDCARD)
            rank = (same, template.count(WILDCARD))
            if rank > most:
                best, most = self._live[number], rank
        return best if best and most[0] / len(tokens) >= self.config.similarity else None

    # -- state --

    def _index(self, cluster: _Cluster, template: tuple[str, ...]) -> None:
        for i, t in enumerate(cluster.template):
            if t != WILDCARD and (not template or template[i] != t):
                self._at[i, t].discard(cluster.number)
                if not self._at[i, t]:
                    del self._at[i, t]
        cluster.template = template

    def add(self, text: str) -> tuple[int, list[tuple[int, str]]]:
        """(cluster number, templates of clusters that were evicted for it) of one message."""
        tokens, gone = tuple(text.split()), []
        found = self._match(tokens)
        if found:
            merged = tuple(a if a == b else WILDCARD for a, b in zip(found.template, tokens, strict=True))
            if merged != found.template:
                self._index(found, merged)
            self._live.move_to_end(found.number)
            return found.number, gone
        leaf = self._make_leaf(tokens)
        cluster = _Cluster(self._next, tokens, leaf)
        self._next += 1
        if len(self._live) >= self.config.max_clusters:
            number, old = self._live.popitem(last=False)
            gone.append((number, " ".join(old.template)))
            del old.leaf.clusters[number]
            self._index(old, ())
            self.evicted += 1
        leaf.clusters[cluster.number] = None
        self._live[cluster.number] = cluster
        for i, t in enumerate(tokens):
            if t != WILDCARD:
                self._at[i, t].add(cluster.number)
        return cluster.number, gone

    def templates(self) -> Iterator[tuple[int, str]]:
        """(cluster number, template) of what is live."""
        for number, c in self._live.items():
            yield number, " ".join(c.template)


def mine_all(messages: Iterable[str], config: MinerConfig | None = None) -> dict[str, str]:
    """The last template of each message's cluster, for messages in ascending order."""
    miner, at, last = TemplateMiner(config), {}, {}
    for m in sorted(set(messages)):
        at[m], gone = miner.add(m)
        last |= dict(gone)
    last |= dict(miner.templates())
    return {m: last[c] for m, c in at.items()}
