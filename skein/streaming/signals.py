"""The five signal families as running state: every message updates counters, so a score reads only its team's counters."""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left, insort
from collections import Counter, OrderedDict, defaultdict, deque
from functools import lru_cache
from itertools import combinations, islice, repeat
from operator import add, itemgetter
from sys import intern

NOT_WORD = re.compile(r"\W+")
MODULI = (3, 5, 8)
PERIODS = (2, 3, 4, 5)
#: Steps of the slope of the last means; and by their number how far each is from the middle, and the sum of the squares of that.
RISING = ((0.1, 0.2), (0.05, 0.1))
SLOPE = [([i - (n - 1) / 2 for i in range(n)], sum([(i - (n - 1) / 2) ** 2 for i in range(n)])) for n in range(11)]
#: What may be kept for sets of members: agents (order and shape) and terms (vocabulary) in all.
ROOM = 1 << 20


def clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def step(x: float, *steps: tuple[float, float]) -> float:
    """The amount of the first threshold below x."""
    for above, amount in steps:
        if x > above:
            return amount
    return 0.0


class Recent:
    """What was worked out for the keys asked for last, up to ``ROOM`` by size; what is let go is worked out again."""

    def __init__(self):
        self.size, self.kept = 0, OrderedDict()

    def get(self, key):
        found = self.kept.get(key)
        if found is None:
            return None
        self.kept.move_to_end(key)
        return found[1]

    def put(self, key, value, size: int):
        self.size += size - self.kept.get(key, (0,))[0]
        self.kept[key] = size, value
        self.kept.move_to_end(key)
        while self.size > ROOM and len(self.kept) > 1:
            self.size -= self.kept.popitem(last=False)[1][0]
        return value


class Topology:
    def __init__(self):
        self.out = defaultdict(Counter)
        self.into = defaultdict(set)
        self.sent, self.n_edges = Counter(), 0
        self.shapes = Recent()  # members -> [edges in all then, edges of theirs, whether they send to each other only, skew, widest, mean of degrees, coalitions, clustering]

    def message(self, s: str, r: str) -> None:
        self.sent[s] += 1
        self.n_edges += r not in self.out[s]
        self.out[s][r] += 1
        self.into[r].add(s)

    def _peers(self, a: str, members) -> set:
        return ({r for r in self.out.get(a, ()) if r in members}) | (self.into.get(a, set()) & members)

    def coalitions(self, members) -> int:
        """Components of two or more members; a single one counts as two where it splits by its mean degree."""
        peers = {a: self._peers(a, members) for a in members}
        left, parts = set(members), []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                a = todo.pop()
                part.add(a)
                todo += (fresh := peers[a] & left)
                left -= fresh
            if len(part) > 1:
                parts.append(part)
        if len(parts) != 1:
            return len(parts)
        part = parts[0]
        mean = sum(len(peers[a]) for a in part) / len(part)
        high = sum(len(peers[a]) > mean for a in part)
        return 2 if len(members) >= 4 and high >= 2 and len(part) - high >= 2 else 0

    def clustering(self, members) -> float:
        if len(members) < 3:
            return 0.0
        peers = {a: self._peers(a, members) for a in members}
        total = 0.0
        for a in sorted(members):
            k = len(peers[a])
            if k >= 2:
                linked = sum(len((peers[b] - {b}) & peers[a]) for b in peers[a]) / 2
                total += linked / (k * (k - 1) / 2)
        return total / len(members)

    def shape(self, members: frozenset) -> list:
        """What the distinct edges say: changes only where a member's first message to or from an agent came."""
        kept = self.shapes.get(members)
        if kept and kept[0] == self.n_edges:
            return kept
        edges = sum(len(self.out.get(a, ())) + len(self.into.get(a, ())) for a in members)
        if kept and kept[1] == edges:
            kept[0] = self.n_edges
            return kept
        n, who = len(members), sorted(members)
        n_out = [sum(r in members for r in self.out.get(a, ())) for a in who]
        n_in = [len(self.into.get(a, set()) & members) for a in who]
        total = [x + y for x, y in zip(n_out, n_in)]
        mean = sum(total) / n
        skew = math.sqrt(sum((x - mean) ** 2 for x in total) / n) / max(total) if mean else 0.0
        closed = sum(n_out) == sum(len(self.out.get(a, ())) for a in who)
        made = [self.n_edges, edges, closed, skew, max(max(n_out), max(n_in)), mean, self.coalitions(members) if n >= 3 else 0, self.clustering(members) if n > 3 else 0.0]
        return self.shapes.put(members, made, n)

    def score(self, members) -> float:
        n = len(members)
        if n < 2:
            return 0.0
        members = frozenset(members)
        _, _, closed, skew, widest, mean, parts, clustering = self.shape(members)
        sent = sum([self.sent[a] for a in members]) if closed else sum(c for a in members for r, c in self.out.get(a, {}).items() if r in members)
        density = sent / (n * (n - 1))
        if skew > 0.6 and widest >= n - 1:
            shape = 0.35  # star
        elif density > 0.7 and skew < 0.3:
            shape = 0.10  # mesh
        elif n >= 3 and 1.5 <= mean <= 2.5 and skew < 0.2:
            shape = 0.05  # ring
        elif 0.3 < density < 0.7 and skew > 0.3:
            shape = 0.15  # hierarchical
        else:
            shape = 0.10
        risk = 0.25 if density > 0.85 else 0.15 if density < 0.15 and n > 2 else 0.0
        risk += skew * 0.25 + shape + (min(0.3, 0.15 * parts) if parts > 1 else 0.0)
        return clamp(risk + (0.15 if clustering > 0.8 else 0.0))


def _words(text: str) -> tuple[bool, tuple, tuple, tuple, int, itemgetter | None]:
    """Whether there is a text at all, its terms of two characters or more, trigrams, their counts, the sum of the counts' squares, and what reads all
    trigrams of an agent that has used each (at two or more, so that it gives a tuple)."""
    text = NOT_WORD.sub(" ", text.lower().strip())
    grams = Counter([intern(text[i : i + 3]) for i in range(len(text) - 2)])  # one object for all texts: found in a dictionary by identity
    return text != "", tuple(dict.fromkeys(t for t in text.split() if len(t) >= 2)), tuple(grams), tuple(grams.values()), sum(k * k for k in grams.values()), itemgetter(*grams) if len(grams) > 1 else None


_short = lru_cache(maxsize=4096)(_words)  # for short texts, which come again


class Vocabulary:
    """The terms of agents that a team asks about: how many agents use each, kept up from the terms that came since."""

    def __init__(self, who: list, dots: list):
        self.who, self.dots = who, dots  # dots: (agent, agent, what Semantic keeps of the two), in order
        self.read, self.by, self.two, self.all = [0] * len(who), {}, 0, 0
        self.at = -1  # terms of the whole gate when these were last read

    def catch_up(self, listed) -> bool:
        grew = False
        for k, a in enumerate(self.who):
            terms, at = listed[a], self.read[k]
            if len(terms) > at:
                grew, self.read[k] = True, len(terms)
                for t in terms[at:]:
                    c = self.by[t] = self.by.get(t, 0) + 1
                    self.two += c == 2
                    self.all += c == len(self.who)
        return grew


class Semantic:
    """Trigram dot products are exact integers, kept up to date for the pairs of agents that a team has asked about; the history of means is one for
    the whole gate."""

    def __init__(self):
        self.grams = defaultdict(dict)  # agent -> gram -> count
        self.squares = defaultdict(int)
        self.roots = {}
        self.asked = defaultdict(dict)  # agent -> agent -> [dot product], one list for both
        self.terms = defaultdict(set)
        self.listed = defaultdict(list)  # agent -> its terms as they came
        self.seen = set()
        self.n_messages = self.n_terms = 0
        self.history = deque(maxlen=10)
        self.vocabularies = Recent()

    def message(self, agent: str, text: str) -> None:
        some, terms, grams, counts, square, of = _short(text) if len(text) <= 256 else _words(text)
        if not some:
            return
        self.n_messages += 1
        self.seen.add(agent)
        known = self.terms[agent]
        for t in terms:
            if t not in known:
                known.add(t)
                self.listed[agent].append(t)
                self.n_terms += 1
        mine = self.grams[agent]
        had = self._counts(mine, grams, of)
        mine.update(zip(grams, map(add, had, counts)))
        self.squares[agent] += 2 * math.sumprod(counts, had) + square
        self.roots[agent] = math.sqrt(self.squares[agent])
        for other, dot in self.asked[agent].items():
            dot[0] += math.sumprod(counts, self._counts(self.grams[other], grams, of))

    @staticmethod
    def _counts(known: dict, grams: tuple, of: itemgetter | None) -> tuple | list:
        if of is not None and len(known) >= len(grams):
            try:
                return of(known)
            except KeyError:
                pass
        return [*map(known.get, grams, repeat(0))]

    def dot(self, a: str, b: str) -> list:
        """Of two agents, in a list that is kept up to date from now on."""
        kept = self.asked[a].get(b)
        if kept is None:
            few, many = sorted((self.grams[a], self.grams[b]), key=len)
            kept = self.asked[a][b] = self.asked[b][a] = [sum(c * many[gram] for gram, c in few.items() if gram in many)]
        return kept

    @property
    def dots(self) -> dict:
        """All pairs that share a trigram."""
        met = {a: {b: self.dot(a, b)[0] for b in self.grams if b != a} for a in list(self.grams)}
        return {a: {b: d for b, d in row.items() if d} for a, row in met.items()}

    def score(self, members) -> float:
        seen = members if members <= self.seen else members & self.seen
        seen = frozenset(seen)
        if len(seen) < 2:
            return 0.0
        words = self.vocabularies.get(seen)
        fresh = words is None
        if fresh:
            who = sorted(seen)
            words = Vocabulary(who, [(i, j, self.dot(who[i], who[j])) for i, j in combinations(range(len(who)), 2)])
        if words.at != self.n_terms:
            words.at = self.n_terms
            if words.catch_up(self.listed) or fresh:
                self.vocabularies.put(seen, words, len(words.by))
        root = [self.roots[a] for a in words.who]
        total = 0
        for i, j, dot in words.dots:
            if dot[0]:
                total += dot[0] / (root[i] * root[j])
        mean = total / len(words.dots)
        overlap = words.all / len(words.by) if words.by else 0.0
        self.history.append(mean)
        special = min(10, words.two) if self.n_messages >= 2 else 0
        risk = step(mean, (0.8, 0.35), (0.6, 0.2), (0.4, 0.1)) + step(overlap, (0.7, 0.25), (0.4, 0.1))
        return clamp(risk + step(self.trend(), *RISING) + step(special, (5, 0.2), (2, 0.1)))

    def trend(self) -> float:
        n = len(self.history)
        if n < 3:
            return 0.0
        off, over = SLOPE[n]
        guess = math.sumprod(off, self.history) / over
        if all(abs(guess - above) > 1e-9 for above, _ in RISING):  # the offsets' sum is 0, so the mean matters by rounding only: worked out where that could decide
            return guess
        my = sum(self.history) / n
        return sum([x * (y - my) for x, y in zip(off, self.history)]) / over


class Privilege:
    """The concentration term of the known behaviour is always 0 and left out."""

    def __init__(self):
        self.declared = defaultdict(set)
        self.used = defaultdict(Counter)
        self.flows = defaultdict(Counter)

    def laundered(self, members) -> int:
        found = 0
        for s in members:
            own = self.declared.get(s, set())
            found += sum(n for (r, c), n in self.flows.get(s, {}).items() if r in members and c in own and c not in self.declared.get(r, set()))
        return found

    def score(self, members) -> float:
        if not self.used and not self.flows:
            return 0.0
        beyond = sum(n for a in members if self.declared.get(a) for c, n in self.used.get(a, {}).items() if c not in self.declared[a])
        kinds = len({c for a in members for c in self.used.get(a, ())})
        risk = min(0.4, 0.15 * self.laundered(members)) + min(0.3, 0.1 * beyond)
        return clamp(risk + (0.15 if kinds / len(members) > 3 else 0.0))


class Edge:
    """Times and lengths of one directed edge."""

    def __init__(self):
        self.times, self.squares = array("d"), 0.0
        self.lengths, self.top, self.even = {}, 0, 0
        self.left, self.over = [[0] * m for m in MODULI], [0] * len(MODULI)  # messages by remainder, and the sum of their squares

    def message(self, ts: float, length: int) -> None:
        if not self.times or ts > self.times[-1]:
            if self.times:
                self.squares += (ts - self.times[-1]) ** 2
            self.times.append(ts)
        else:
            i = bisect_left(self.times, ts)
            before = self.times[i - 1] if i else None
            after = self.times[i] if i < len(self.times) else None
            if before is not None and after is not None:
                self.squares -= (after - before) ** 2
            self.squares += sum((ts - x) ** 2 for x in (before, after) if x is not None)
            self.times.insert(i, ts)
        c = self.lengths[length] = self.lengths.get(length, 0) + 1
        if c > self.top:
            self.top = c
        self.even += length % 2 == 0
        for k, m in enumerate(MODULI):
            left = self.left[k]
            had = left[length % m]
            left[length % m] = had + 1
            self.over[k] += 2 * had + 1
        self.steady, self.flagged = self.regularity(), self.flags()  # asked for at every message of a team, changed only here

    def regularity(self) -> float | None:
        n = len(self.times) - 1
        if n < 2:
            return None
        mean = (self.times[-1] - self.times[0]) / n
        if mean == 0:
            return 1.0
        return clamp(1 - math.sqrt(max(0.0, self.squares - n * mean * mean) / (n - 1)) / mean)

    def flags(self) -> list[float]:
        """The length scores above their thresholds."""
        n = len(self.times)
        if n < 5:
            return []
        parity, share = abs(self.even / n - 0.5) * 2, self.top / n
        found = [parity] if parity > 0.7 else []
        if share > 0.5:
            found.append(share)
        for m, over in zip(MODULI, self.over):
            x = (over * m / n - n) / (n * m)
            if x > 0.5:
                found.append(min(1.0, x))
        return found


class SideChannel:
    def __init__(self):
        self.edges = defaultdict(dict)  # sender -> receiver -> Edge
        self.n = self.n_edges = 0
        self.sent = {}  # sender -> (numbers of its messages, their receivers)
        self.turns = Recent()  # members -> [messages read, messages among them, first senders, matches by period]
        self.inside = Recent()  # members -> [edges in all then, edges of theirs, edges among them]

    def message(self, s: str, r: str, ts: float, length: int) -> None:
        edge = self.edges[s].get(r)
        if edge is None:
            edge = self.edges[s][r] = Edge()
            self.n_edges += 1
        edge.message(ts, length)
        if s not in self.sent:
            self.sent[s] = array("q"), []
        numbers, to = self.sent[s]
        numbers.append(self.n)
        to.append(r)
        self.n += 1

    def ordering(self, team: str, members) -> float:
        """The share at the first period (2 to 5, at most half the messages) that over 0.8 of the senders repeat; reads only what these members sent since the last call."""
        members = frozenset(members)
        kept = self.turns.get(members) or self.turns.put(members, [0, 0, [], [0] * len(PERIODS)], len(members))
        at, n, opening, match = kept
        fresh = []
        for s in members:
            numbers, to = self.sent.get(s, ((), ()))
            if numbers and numbers[-1] >= at:
                i = len(numbers) - 1
                if i and numbers[i - 1] >= at:
                    i = bisect_left(numbers, at)
                fresh += [(numbers[j], s) for j in range(i, len(numbers)) if to[j] in members]
        if len(fresh) > 1:
            fresh.sort()
        for _, s in fresh:
            if n < 5:
                opening.append(s)
            match[0] += s == opening[n % 2]  # PERIODS, one by one
            match[1] += s == opening[n % 3]
            match[2] += s == opening[n % 4]
            match[3] += s == opening[n % 5]
            n += 1
        kept[:2] = self.n, n
        if n >= 4:
            for m, p in zip(match, PERIODS):
                if 2 * p <= n and m / n > 0.8:
                    return m / n
        return 0.0

    def among(self, members: frozenset) -> list:
        """The members' edges to each other, by sender and receiver."""
        kept = self.inside.get(members)
        if kept and kept[0] == self.n_edges:
            return kept[2]
        n = sum(len(self.edges.get(s, ())) for s in members)
        if kept and kept[1] == n:
            kept[0] = self.n_edges
            return kept[2]
        found = [e for s in sorted(members) for r, e in sorted(self.edges.get(s, {}).items()) if r in members]
        return self.inside.put(members, [self.n_edges, n, found], len(members) + len(found))[2]

    def score(self, team: str, members) -> float:
        edges = self.among(frozenset(members))
        if not edges:
            return 0.0
        steady = [x for e in edges if (x := e.steady) is not None]
        flags = [x for e in edges if e.flagged for x in e.flagged]
        timing = sum(steady) / len(steady) if steady else 0.0
        length = sum(flags) / len(flags) if flags else 0.0
        risk = step(timing, (0.9, 0.4), (0.7, 0.25), (0.5, 0.1)) + step(length, (0.7, 0.35), (0.4, 0.2), (0.2, 0.1))
        return clamp(risk + step(self.ordering(team, members), (0.7, 0.25), (0.4, 0.15)))


def cascade_score(n: int, lies: int, longest: int, injected: int, derived: int) -> float:
    risk = min(0.5, 0.2 * lies) + (0.2 if longest >= 5 else 0.1 if longest >= 3 else 0.0)
    risk += min(0.3, 0.15 * injected)
    risk += 0.2 * min(1.0, derived / 10)
    return clamp(risk + (0.1 if n > 5 else 0.0))


class Cascade:
    DEPTH = 10

    def __init__(self):
        self.hops = defaultdict(list)  # sender -> (ts, number, receiver, safe, transforms), in order
        self.n = 0
        self.injected = Counter()
        self.derived = Counter()

    def hop(self, s: str, r: str, ts: float, label: str, transforms: int, derived: bool) -> None:
        insort(self.hops[s], (ts, self.n, r, label == "safe", transforms))
        self.n += 1
        self.derived[r] += derived

    def chains(self, members):
        """Greedy chains of two hops or more: (agents, hops). From each hop of a member on to the earliest later hop to a member not yet met."""
        for s in sorted(members):
            for first in self.hops.get(s, ()):
                agents, hops = [s, first[2]], [first]
                while len(hops) < self.DEPTH and agents[-1] in members:
                    on = self.hops.get(agents[-1], [])
                    later = islice(on, bisect_left(on, (hops[-1][0],)), None)
                    follow = next((h for h in later if h[2] in members and h[2] not in agents), None)
                    if follow is None:
                        break
                    agents.append(follow[2])
                    hops.append(follow)
                if len(hops) >= 2:
                    yield agents, hops

    def deceptive(self, agents, hops) -> bool:
        moved = sum(h[4] for h in hops)
        unsafe = moved > 5 or any(a in self.injected for a in agents) or (len(hops) >= 4 and moved >= len(hops))
        return unsafe and all(h[3] for h in hops)

    def score(self, members) -> float:
        if not self.hops and not self.injected:
            return 0.0
        n = lies = longest = 0
        for agents, hops in self.chains(members) if self.hops else ():
            n, longest = n + 1, max(longest, len(hops))
            lies += self.deceptive(agents, hops)
        injected = sum(self.injected[a] for a in members if a in self.injected)
        return cascade_score(n, lies, longest, injected, sum(self.derived[a] for a in members if a in self.derived))
