"""Spelling variants: words one edit apart, found by forward and backward automata.

Of two words one insertion, deletion or replacement apart, cut at half the shorter
one's length, either the first halves are equal or the second halves are. So words
are filed by their first half and, reversed, by their second half. A task reads
words of the same halves together, builds a minimal acyclic automaton of them,
whose states know how many words they lead to, so that a path spells a word's
number (a perfect hash), and asks it for every word: the equal half is walked
exactly, the rest is completed with one error.

A half that over ``CROWD`` words share is split further: the half that may differ is
cut again, and the words are filed by what must be equal then, in either of two
ways, until no group is too large. At the finest cut a group shares all but one
or two letters, so an alphabet bounds it. A pair is told by exactly one group, the
one whose cut holds the end of its longest common prefix, so nothing is told
twice between tasks; within one, word numbers are held against each other.

Defined cases: null texts have no words; a null doc_id counts as an empty one; texts are
read whole; the letters are ASCII's and those from U+00C0 to U+00FF (its two signs
included); ties go to the word that comes first in code-point order; repeated rows
count as often as they are; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import FEW
from ledgerlens.llm.store import forget, staged

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that may share a half before it is split; words that a task holds at once.
CROWD = 20_000


# --- the automaton


class Automaton:
    """The minimal acyclic automaton of sorted distinct words. ``edges[s]``: letter to state; ``words[s]``: how many words it leads to; ``final[s]``."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        register: dict[tuple, int] = {}
        path = [0]  # states of the last word, not yet known to be minimal but for those before
        before = ""

        def settle(depth: int) -> None:
            for at in range(len(path) - 1, depth, -1):
                state, parent, letter = path[at], path[at - 1], before[at - 1]
                key = (self.final[state], *self.edges[state].items())
                same = register.setdefault(key, state)
                if same != state:
                    self.edges[parent][letter] = same
                    spare.append(state)
            del path[depth + 1 :]

        spare: list[int] = []
        for word in words:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            settle(shared)
            for letter in word[shared:]:
                if spare:
                    state = spare.pop()
                    self.edges[state], self.final[state] = {}, False
                else:
                    state = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                self.edges[path[-1]][letter] = state
                path.append(state)
            self.final[path[-1]] = True
            before = word
        settle(0)
        self._count()

    def _count(self) -> None:
        self.words = [-1] * len(self.edges)
        todo = [0]
        while todo:
            state = todo[-1]
            open_ = [t for t in self.edges[state].values() if self.words[t] < 0]
            if open_:
                todo += open_
            else:
                todo.pop()
                self.words[state] = self.final[state] + sum(self.words[t] for t in self.edges[state].values())
        # each letter with its state and the number of words that come before it there
        self.steps: list[dict[str, tuple[int, int]]] = []
        for state, edges in enumerate(self.edges):
            n, steps = int(self.final[state]), {}
            for letter, to in edges.items():
                steps[letter] = (to, n)
                n += self.words[to]
            self.steps.append(steps)

    def number(self, word: str, state: int = 0, n: int = 0) -> int:
        """The word's place in sorted order; -1 if it is none of them."""
        steps = self.steps
        for letter in word:
            step = steps[state].get(letter)
            if step is None:
                return -1
            state, n = step[0], n + step[1]
        return n if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words one replacement or one insertion away that share the first ``exact`` letters."""
        state = n = 0
        steps, final, number = self.steps, self.final, self.number
        for letter in word[:exact]:
            step = steps[state].get(letter)
            if step is None:
                return set()
            state, n = step[0], n + step[1]
        found = set()
        for at in range(exact, len(word)):
            here, rest, letter = steps[state], word[at + 1 :], word[at]
            own = here.get(letter)
            for other, (to, add) in here.items():
                if other != letter and (got := number(rest, to, n + add)) >= 0:
                    found.add(got)
                if (step := steps[to].get(letter)) is not None and (got := number(rest, step[0], n + add + step[1])) >= 0:
                    found.add(got)
            if own is None:
                return found
            state, n = own[0], n + own[1]
        for to, add in steps[state].values():
            if final[to]:
                found.add(n + add)
        return found


# --- words and their counts


def words_of(docs: DataFrame, every: int | None = 31, shortest: int = 7) -> DataFrame:
    """``word, n`` of every distinct word of ``docs`` (doc_id, text) with at least ``shortest`` letters.

    With ``every``, a run loses one letter if that number divides the CRC-32 of
    ``<doc_id>:<run>``: planted misspellings, the letter's place is the CRC modulo the run's length.
    """
    text = F.translate(F.make_valid_utf8(F.col("text")), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(RUN + "{" + str(shortest) + ",}"), F.lit(0))).alias("run"))
    if every is None:
        words = runs.select(F.col("run").alias("word"))
    else:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
        gone = F.pmod(F.col("h"), F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
        words = runs.withColumn("h", h).select(F.when(F.pmod(F.col("h"), F.lit(every)) == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n"))


# --- words that share a half


def _filed(words: DataFrame) -> DataFrame:
    """A word four times: as the shorter of a pair and as the longer, by its first half and by its second.

    ``m``: length of the pair's shorter word; ``a``, ``e``: where the longest common prefix of a pair ends that
    this group tells, ``a`` to ``e - 1``, or to the end if ``e`` is ``m``.
    """
    n = F.length("word")
    roles = words.withColumn("m", F.explode(F.array(n, n - 1)))
    half = F.floor(F.col("m") / 2).cast("int")
    spans = F.array(F.struct(half.alias("a"), F.col("m").alias("e")), F.struct(F.lit(0).alias("a"), half.alias("e")))
    return roles.select("word", "n", "m", F.inline(spans))


def _key(rows: DataFrame) -> DataFrame:
    """What must be equal in a group: the letters before ``a``, and as many at the end as the shorter word has after ``e``."""
    end = F.col("m") - F.col("e")
    tail = F.when(end > 0, F.right("word", end)).otherwise("")
    return rows.withColumn("key", F.concat_ws("/", "m", "a", F.substring("word", F.lit(1), F.col("a")), tail))


def _groups(words: DataFrame, crowd: int) -> DataFrame:
    """``_filed`` rows with ``key``; hot ones are cut until none has more than ``crowd`` rows, or its span is one letter."""
    rows, done = _key(_filed(words)), []
    while True:
        hot = staged(rows.where("e - a > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select("key"), "spelling-hot")
        n = hot.limit(FEW + 1).count()
        if not n:
            forget(hot)
            break
        few = F.broadcast(hot) if n <= FEW else hot
        done.append(rows.join(few, "key", "left_anti"))
        mid = F.floor((F.col("a") + F.col("e")) / 2).cast("int")
        spans = F.array(F.struct(F.col("a"), mid.alias("e")), F.struct(mid.alias("a"), F.col("e")))
        rows = _key(rows.join(few, "key", "left_semi").select("word", "n", "m", F.inline(spans)))
    for more in done:
        rows = rows.unionByName(more)
    return rows


def _best(now: list | None, n: int, word: str) -> list:
    if now is None:
        return [1, n, word]
    now[0] += 1
    if n > now[1] or n == now[1] and word < now[2]:
        now[1:] = n, word
    return now


def _block(rows: pd.DataFrame, forward: bool) -> pd.DataFrame:
    """Near pairs of whole groups: for each word how many it has here, and the best of them."""
    counts = dict(zip(rows["word"], rows["n"]))
    turned = (lambda w: w) if forward else (lambda w: w[::-1])
    words = sorted(map(turned, counts))
    automaton = Automaton(words)
    near: dict[str, list] = {}
    asks = rows[rows["word"].str.len() == rows["m"]]
    for word, m, a, e in zip(asks["word"], asks["m"], asks["a"], asks["e"]):
        for number in automaton.near(turned(word), a if forward else m - e):
            other = turned(words[number])
            if len(other) == m and other < word:
                continue  # of two equally long words the first one asks
            p = 0
            for x, y in zip(word, other):
                if x != y:
                    break
                p += 1
            if p >= a and (p < e or e == m):
                near[word] = _best(near.get(word), counts[other], other)
                near[other] = _best(near.get(other), counts[word], word)
    return pd.DataFrame([(w, *b) for w, b in near.items()], columns=["word", "n_near", "best_n", "best"])


def _told(crowd: int, forward: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest) < 2 * crowd:
                continue
            # all groups but the last, which may go on
            cut = int((rest["key"].to_numpy() != rest["key"].iloc[-1]).sum())
            if cut >= crowd:
                yield _block(rest.iloc[:cut], forward)
                rest = rest.iloc[cut:]
        if rest is not None and len(rest):
            yield _block(rest, forward)

    return run


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, n_near, best`` of every word of ``words`` (word, n; distinct) that has a near one: how many, and the most frequent."""
    rows = staged(_groups(words, crowd), "spelling-groups")
    told = None
    for forward in (True, False):
        # the longer of the two equal ends is walked exactly
        side = rows.where((F.col("a") >= F.col("m") - F.col("e")) == F.lit(forward))
        sorted_ = side.repartition("key").sortWithinPartitions("key")
        part = sorted_.mapInPandas(_told(crowd, forward), "word string, n_near long, best_n long, best string")
        told = part if told is None else told.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("back"), F.col("best").alias("word"))).alias("best")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.back")).alias("best_n"))


def variants(docs: DataFrame, every: int | None = None, shortest: int = 7, least: int = 2, times: int = 10, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the words of ``docs`` (doc_id, text) that occur ``least`` times, and what they are misspellings of.

    A word's form is its near word of most occurrences, if those are ``times`` its own; its root is where forms of forms end.
    """
    words = staged(words_of(docs, every, shortest).where(F.col("n") >= least), "spelling-words")
    near = near_words(words, crowd)
    is_form: Column = F.col("best_n") >= times * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    named = staged(named, "spelling-forms")
    # counts grow tenfold from form to form, so a few doublings reach every root; one word has few near words, so no form is a hot key
    links = named.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = staged(links.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        links = now.select("word", "root")
        if not now.where("moved").limit(1).count():
            break
    return named.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
