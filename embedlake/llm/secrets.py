"""Secret scan: fixed patterns, and credential formats inferred as automata.

Format learning is state merging on prefix trees: the labelled credentials of
one format form a tree with counts, and states whose outgoing frequencies agree
within a Hoeffding bound are merged, so that a random body folds into a loop
while a fixed head stays a chain. The result is a probabilistic automaton. Any
candidate string is scored against all automata and against a model of plain
names and words; the log likelihood ratio per character decides. A merged loop
forgets how long its body was, so each format also keeps the lengths of its
examples. Candidates are runs of the characters that credentials have, and the
parts of a run between any two of its `=`, `/` and `.`, of every length that a
learnt format has.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm import batches

# Fixed values of the base rules.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "format"]
LEAST = {"assign": 12, "access": 18, "hex": 16}

MARKS = "=/."
# A format whose examples have so many lengths or more has no greatest one.
VARIED = 6
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

# Log likelihood ratio per character from which a candidate counts as a secret.
MARGIN = 0.3


def labelled(per_format: int = 80, seed: int = 7) -> list[tuple[str, str]]:
    """(format, example) rows: the small labelled table the automata learn from.

    Heads and lengths are those that public services document for their keys;
    bodies are drawn at random. Rows of format `plain` are long names, paths
    and numbers that are no secrets.
    """
    draw = random.Random(seed)
    body = lambda letters, n: "".join(draw.choices(letters, k=n))
    alnum, url = LOWER + UPPER + DIGIT, LOWER + UPPER + DIGIT + "_-"
    rows = []
    for _ in range(per_format):
        rows += [
            ("code host", "gh" + draw.choice("pousr") + "_" + body(alnum, 36)),
            ("code host", "glpat-" + body(url, 20)),
            ("payment", draw.choice(["sk", "rk"]) + "_" + draw.choice(["live", "test"]) + "_" + body(alnum, 24)),
            ("chat", "xox" + draw.choice("bpas") + "-" + body(DIGIT, 12) + "-" + body(DIGIT, 12) + "-" + body(alnum, 24)),
            ("maps", "AIza" + body(url, 35)),
            ("signed token", "eyJ" + body(url, 17) + ".eyJ" + body(url, draw.randint(30, 60)) + "." + body(url, 43)),
            ("package host", "npm_" + body(alnum, 36)),
            ("mail", "SG." + body(url, 22) + "." + body(url, 43)),
            ("base64 key", body(alnum + "+/", draw.choice([43, 86])) + "="),
            ("plain", draw.choice("_-./").join(body(LOWER, draw.randint(2, 9)) for _ in range(draw.randint(3, 6)))),
            ("plain", "".join(body(LOWER, draw.randint(3, 8)).title() for _ in range(draw.randint(3, 6)))),
            ("plain", body(LOWER, draw.randint(20, 40))),
            ("plain", body(DIGIT, draw.randint(20, 30))),
            ("plain", body("-=_.", 1) * draw.randint(20, 60)),
            ("plain", f"{body(LOWER, 6)}-{draw.randint(1990, 2030)}-{draw.randint(1, 12)}-{body(LOWER, 8)}.{body(LOWER, 3)}"),
            ("plain", body(UPPER, draw.randint(3, 8)) + "_" + body(UPPER, draw.randint(9, 20))),
        ]
    return rows


def char_class(c: str) -> str:
    return "a" if c in LOWER else "A" if c in UPPER else "0" if c in DIGIT else c


CLASS_SIZE = {"a": 26, "A": 26, "0": 10}


class Automaton:
    """A probabilistic automaton learnt from examples by state merging."""

    def __init__(self, examples: list[str], alpha: float = 0.002):
        # State: [arrivals, stops, {char: [count, target]}].
        self.states: list[list] = [[0, 0, {}]]
        for text in examples:
            at = 0
            for c in text:
                self.states[at][0] += 1
                edge = self.states[at][2].setdefault(c, [0, -1])
                edge[0] += 1
                if edge[1] < 0:
                    edge[1] = len(self.states)
                    self.states.append([0, 0, {}])
                at = edge[1]
            self.states[at][0] += 1
            self.states[at][1] += 1
        # The least and greatest length; of a varied format the latter is open.
        lengths = {len(text) for text in examples}
        self.lengths = lengths if len(lengths) < VARIED else None
        self.least, self.most = min(lengths), max(lengths) if len(lengths) < VARIED else math.inf
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self._smooth()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, p: int, q: int) -> bool:
        """Do stops, characters and classes agree, here and below? Walks one tree."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, stop_p, out_p = self.states[p]
            m, stop_q, out_q = self.states[q]
            # So few examples differ from nothing, nor do their parts.
            if m <= self.bound**2:
                continue
            if self._differ(stop_p, n, stop_q, m):
                return False
            for key in out_p.keys() | out_q.keys():
                if self._differ(out_p.get(key, (0,))[0], n, out_q.get(key, (0,))[0], m):
                    return False
            by_p, by_q = Counter(), Counter()
            for c, e in out_p.items():
                by_p[char_class(c)] += e[0]
            for c, e in out_q.items():
                by_q[char_class(c)] += e[0]
            if any(self._differ(by_p[k], n, by_q[k], m) for k in by_p.keys() | by_q.keys()):
                return False
            todo += [(out_p[c][1], out_q[c][1]) for c in out_p.keys() & out_q.keys()]
        return True

    def _unseen(self, s: int) -> dict[str, float]:
        """Share of each character of a class at a state, drawn there or not.

        A class met as few different characters is a fixed head, not a body.
        """
        n, _, out = self.states[s]
        counts, kinds = Counter(), Counter()
        for c, e in out.items():
            counts[char_class(c)] += e[0]
            kinds[char_class(c)] += 1
        spread = {k: max(kinds[k] - 1, 0.01) / CLASS_SIZE[k] if k in CLASS_SIZE else 1.0 for k in kinds}
        return {k: 0.5 * counts[k] / n * spread[k] / CLASS_SIZE.get(k, 1) for k in counts}

    def _likeness(self, p: int, q: int, by_state: dict[int, dict]) -> float:
        """Mean log likelihood of the tree below q from state p, as far as p goes along.

        `by_state` remembers the class shares of states until the next merge.
        """
        total, weight, todo = 0.0, 0, [(p, q)]
        while todo:
            p, q = todo.pop()
            n, stops, out = self.states[p]
            _, ends, below = self.states[q]
            by_class = by_state.get(p)
            if by_class is None:
                by_class = by_state[p] = self._unseen(p)
            if ends:
                total += ends * math.log((stops + 0.05) / (n + 0.1))
            weight += ends
            for c, (count, target) in below.items():
                kind = char_class(c)
                share = 0.5 * out.get(c, (0,))[0] / n + by_class.get(kind, 0.0)
                total += count * math.log(max(share, 1e-6))
                weight += count
                if c in out:
                    todo.append((out[c][1], target))
        return total / weight

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to state p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.states[p][0] += self.states[q][0]
            self.states[p][1] += self.states[q][1]
            for c, (count, target) in self.states[q][2].items():
                edge = self.states[p][2].get(c)
                if edge is None:
                    self.states[p][2][c] = [count, target]
                else:
                    edge[0] += count
                    todo.append((edge[1], target))

    def _merge_all(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.states[0][2])]
        while blue:
            source, c = blue.pop(0)
            target = self.states[source][2][c][1]
            if target in red:
                continue
            # A rare branch is compatible with much; it goes with its class, or where it is likeliest.
            fitting = [state for state in red if self._compatible(state, target)]
            if fitting:
                alike = [e for x, e in self.states[source][2].items() if char_class(x) == char_class(c) and e[1] in red]
                seen: dict[int, dict] = {}
                if self.states[target][0] <= self.bound**2 and alike:
                    state = max(alike)[1]
                else:
                    state = max(fitting, key=lambda r: (self._likeness(r, target, seen), -r))
                self.states[source][2][c][1] = state
                self._fold(state, target)
            else:
                red.append(target)
            known = set(red)
            blue = [(s, x) for s in red for x in sorted(self.states[s][2]) if self.states[s][2][x][1] not in known]
            # Frequent branches first.
            blue.sort(key=lambda b: -self.states[b[0]][2][b[1]][0])
        self.kept = red

    def _smooth(self) -> None:
        """Log probabilities; an unseen character of a seen class goes with its class."""
        self.moves: dict[int, tuple[dict, dict, float]] = {}
        for s in self.kept:
            n, stops, out = self.states[s]
            by_class: dict[str, Counter] = {}
            for c, (count, target) in out.items():
                by_class.setdefault(char_class(c), Counter())[target] += count
            classes = {k: (math.log(share), by_class[k].most_common(1)[0][0]) for k, share in self._unseen(s).items()}
            # A state with two of the three classes is inside a body: the third was not drawn yet.
            mixed = [k for k in by_class if k in CLASS_SIZE]
            if len(mixed) == 2:
                unseen = next(k for k in CLASS_SIZE if k not in mixed)
                target = sum((by_class[k] for k in mixed), Counter()).most_common(1)[0][0]
                classes[unseen] = (math.log(0.5 / (n + 1) / CLASS_SIZE[unseen]), target)
            chars = {}
            for c, (count, target) in out.items():
                k = char_class(c)
                whole, every = sum(by_class[k].values()), math.exp(classes[k][0])
                # What its class takes away from the character comes back in part.
                share = count / n - count / whole * every * CLASS_SIZE.get(k, 1) + every
                chars[c] = (math.log(share), target)
            self.moves[s] = (chars, classes, math.log((stops + 0.05) / (n + 0.1)))

    def fits(self, length: int) -> bool:
        """Is this a length of the format?"""
        return length in self.lengths if self.lengths is not None else length >= self.least

    def score(self, text: str) -> float:
        """Log probability of the text, or minus infinity."""
        if not self.fits(len(text)):
            return -math.inf
        at, total = 0, 0.0
        for c in text:
            chars, classes, _ = self.moves[at]
            move = chars.get(c) or classes.get(char_class(c))
            if move is None:
                return -math.inf
            total += move[0]
            at = move[1]
        return total + self.moves[at][2]


class Formats:
    """Automata by format, and a model of characters by the one before for the rest."""

    def __init__(self, rows: list[tuple[str, str]], alpha: float = 0.002):
        groups: dict[str, list[str]] = {}
        for kind, text in rows:
            if kind is not None and text:
                groups.setdefault(kind, []).append(text)
        plain = groups.pop("plain", [])
        self.automata = {k: Automaton(v, alpha) for k, v in groups.items()}
        self.least = min((a.least for a in self.automata.values()), default=math.inf)
        pairs, singles = Counter(), Counter()
        for text in plain:
            for a, b in zip("^" + text, text):
                pairs[char_class(a), char_class(b)] += 1
                singles[char_class(a)] += 1
        self.pairs = {k: math.log((v + 0.5) / (singles[k[0]] + 5) / CLASS_SIZE.get(k[1], 1)) for k, v in pairs.items()}
        self.rare = math.log(1e-4)

    def ratio(self, text: str) -> float:
        """Log likelihood ratio per character of the best format to plain text."""
        best = max((a.score(text) for a in self.automata.values()), default=-math.inf)
        if best == -math.inf:
            return best
        plain = sum(self.pairs.get((char_class(a), char_class(b)), self.rare) for a, b in zip("^" + text, text))
        return (best - plain) / len(text)

    def parts(self, text: str, margin: float) -> list[tuple[float, int, int]]:
        """(log likelihood ratio, start, end) of parts between marks that have
        `margin` or more of it per character.

        Gain is the ratio less `margin` per character. Of the starts that lead
        to one state of an automaton only the best can win once they are long
        enough, so from there each state is followed once per position. Starts
        of a format of fixed lengths stay apart and end at the greatest one.
        """
        n, found = len(text), {}
        starts = {0, *(i + 1 for i, c in enumerate(text) if c in MARKS)}
        ends = {n, *(i for i, c in enumerate(text) if c in MARKS), *(i + 1 for i, c in enumerate(text) if c == "=")}
        kinds = [char_class(c) for c in text]
        inner = [self.pairs.get(pair, self.rare) for pair in zip(["^", *kinds], kinds)]
        first = {i: self.pairs.get((char_class("^"), kinds[i]), self.rare) for i in starts if i < n}
        for automaton in self.automata.values():
            # (state, start if still apart else -1): (gain, start)
            least, most, varied = automaton.least, automaton.most, automaton.lengths is None
            live: dict[tuple[int, int], tuple[float, int]] = {}
            for i in range(n + 1):
                if i in ends:
                    for (state, _), (gain, a) in live.items():
                        whole = gain + automaton.moves[state][2]
                        if automaton.fits(i - a) and whole >= 0 and whole > found.get((a, i), -1.0):
                            found[a, i] = whole
                if i == n:
                    break
                if i in starts and n - i >= least:
                    live[0, i] = (0.0, i)
                moved: dict[tuple[int, int], tuple[float, int]] = {}
                for (state, _), (gain, a) in live.items():
                    chars, classes, _ = automaton.moves[state]
                    move = chars.get(text[i]) or classes.get(kinds[i])
                    if move is None or i + 1 - a > most:
                        continue
                    more = gain + move[0] - (first[i] if a == i else inner[i]) - margin
                    key = (move[1], -1 if varied and i + 1 - a >= least else a)
                    if key not in moved or more > moved[key][0]:
                        moved[key] = (more, a)
                live = moved
        return [(gain + margin * (b - a), a, b) for (a, b), gain in found.items()]


@cache
def default_formats() -> Formats:
    return Formats(labelled())


def learn(labels: DataFrame, kind: str = "kind", text: str = "text", most: int = 20_000, alpha: float = 0.002) -> Formats:
    """Formats of a labelled table of `kind` (`plain` for the rest) and `text`.

    The automata are fitted on at most `most` rows, those of least digest;
    repeated rows count as often as they stand, null and empty ones are left out.
    """
    rows = labels.select(F.col(kind).alias("kind"), F.col(text).alias("text")).where("kind is not null and text <> ''")
    rows = rows.orderBy(F.xxhash64("kind", "text"), "kind", "text").limit(most)
    return Formats([(r["kind"], r["text"]) for r in rows.collect()], alpha)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches that pass, in order."""
    found = []
    if ("=" in text or ":" in text) and any(
        word in lowered for lowered in [text.lower()] for word in ("passw", "secret", "token", "api")
    ):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@cache
def candidates(least: int) -> re.Pattern:
    """Runs of the characters of credentials that may hold one of this length."""
    return re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % least)


def format_spans(text: str, base: list[tuple[int, int, int]], formats: Formats, margin: float) -> list:
    """Candidates outside the base spans whose format likelihood is high enough.

    Of overlapping parts of a run the likeliest one is kept.
    """
    found = []
    if formats.least == math.inf:
        return found
    for m in candidates(formats.least).finditer(text):
        word = m[0].rstrip(".")
        if not any(c in DIGIT or c in UPPER for c in word):
            continue
        if any(c in word for c in MARKS):
            parts = sorted(formats.parts(word, margin), key=lambda p: (-p[0], p[1], p[2]))
        else:
            parts = [(0.0, 0, len(word))] if formats.ratio(word) >= margin else []
        taken = list(base)
        for _, a, b in parts:
            if not any(c in DIGIT or c in UPPER for c in word[a:b]):
                continue
            a, b = m.start() + a, m.start() + b
            if not any(s < b and a < e for s, _, e in taken):
                taken.append((a, 3, b))
                found.append((a, 3, b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(
    docs: DataFrame,
    formats: Formats | None = None,
    margin: float = MARGIN,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`doc_id, spans: array<struct<kind, start, end>>, n_base`, one row per input row.

    Spans are in code points, ends exclusive, ordered by start and kind; base
    spans stay as they are, `format` spans never overlap them. A null or empty
    text has none. Null and repeated ids are kept. Row by row, no shuffle; the
    automata are a few kilobytes and travel with the function.
    """
    learnt = formats or default_formats()

    def run(parts):
        for part in batches.slices(parts):
            rows, counts = [], []
            for words in batches.texts(part):
                base = base_spans(words)
                spans = sorted(base + format_spans(words, base, learnt, margin))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                counts.append(len(base))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, kind), pa.array(counts, "int64")],
                ["doc_id", "spans", "n_base"],
            )

    id_kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {id_kind}, spans array<struct<kind:string,start:bigint,end:bigint>>, n_base long"
    return batches.take(docs, doc_id=doc_id, text=text).mapInArrow(run, schema)
