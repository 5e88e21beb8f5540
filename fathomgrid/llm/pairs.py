"""Defective prompt and response pairs: a conditional random field tags the clauses of a response, and the tags' coverage names the defect."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.plans.durable import materialize
from fathomgrid.plans.skew import hot_keys, lookup_join

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

#: Function words that start the language statistics. Words of several languages are left out.
FUNCTION_WORDS = {
    "en": "the of and to is are with from for this that what how where why when before after around by gets takes your you not it at on or",
    "de": "der die das und ist ein eine einen mit von zu nach für wie was wo wann man dem den vor bei nicht oder im direkt hält wird sich auf",
    "fr": "le les des du et est une avec pour dans quels quel sont où qu ce il faut avant pas ou aux au sur toutes cette combien comment",
    "es": "el los las del y es una con para qué cómo cuál dónde lo hay que antes más cuánto esta sobre cada en por su desde hasta",
    "it": "il gli della di e è una con per che cosa dove quali sono come quanto prima più questa nel alle ogni da si dei degli non",
}
#: Declined answers from which training pairs are made.
REFUSALS = {
    "en": ["I'm sorry, I can't help with this request.", "Unfortunately I am unable to answer that.", "I cannot assist with this, as it is against the guidelines.", "As a language model, I'm not able to provide that.", "I would rather not respond to this.", "I have to decline this one.", "I will pass on this.", "I think I must skip this one."],
    "de": ["Es tut mir leid, dabei kann ich nicht helfen.", "Leider darf ich diese Anfrage nicht beantworten.", "Das ist mir nicht möglich."],
    "fr": ["Désolé, je ne peux pas répondre à cette demande.", "Malheureusement, il m'est impossible d'aider."],
    "es": ["Lo siento, no puedo ayudar con esta solicitud.", "No es posible responder a esa consulta."],
    "it": ["Mi dispiace, non posso rispondere a questa domanda.", "Purtroppo non sono in grado di aiutare con la richiesta."],
}
LEAD_INS = ("", "", "", "Query: ", "You asked: ", "Question - ", "Search: ")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE = re.compile(r"(?<=[.!?])[\"”»')]*\s+(?=\S)")
_DONE = re.compile(r"[.!?…。](?:[\"”“»'’)\]]*)\s*$|\d\s*\)\s*$")


@dataclass(frozen=True)
class PairModel:
    """sample: records (by hash of the identifier) from which labelled training pairs are made. spoken: a word in this share of the records belongs to a language. common: a word in this share is no name. cue, odds: a word in this share of the responses that take up nothing of their query, and so many times as frequent there as elsewhere, is a sign of declining. rounds, rate: gradient steps of the random field."""

    sample: int = 1500
    spoken: float = 0.003
    common: float = 0.02
    cue: float = 0.02
    odds: float = 5.0
    rounds: int = 120
    rate: float = 0.5


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


_SEEDS: dict[str, tuple[str, ...]] = {}
for _lang, _listed in FUNCTION_WORDS.items():
    for _w in _listed.split():
        _SEEDS[_w] = (*_SEEDS.get(_w, ()), _lang)


def _seeded(tokens: list[str], skip: set[str]) -> str | None:
    """The language whose function words a text has most of; None without a clear one."""
    have = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in tokens:
        if w in _SEEDS and w not in skip:
            for lang in _SEEDS[w]:
                have[lang] += 1
    a, b = sorted(have, key=have.get, reverse=True)[:2]
    return a if have[a] >= 2 and have[a] > have[b] else None


def _topic(asked: list[str], common: set[str] | dict) -> set[str]:
    """The words that say what a query is about."""
    return {w for w in asked if len(w) > 4 and w not in common and not w.isdigit()}


#: Stands for the number of records in the statistics.
RECORDS = "\n"


def statistics(records: DataFrame) -> DataFrame:
    """(what, of, word, n, ends) over all records, counted within batches, then summed.

    'end': occurrences of a word in items of a kind and, of these, at their
    end, counted in items that aren't the last, since only the last item of a
    response can be cut off. 'lang': occurrences per language. 'cue': records
    that have the word, by whether the response takes up a topic of its query
    ('there') or none ('nowhere').
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inside: dict[str, Counter] = {}
            ending: dict[str, Counter] = {}
            spoken = {k: Counter() for k in FUNCTION_WORDS}
            cues = {"there": Counter(), "nowhere": Counter()}
            for query, output in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                items = [(i[0] or "", words(i[1])) for i in output or [] if i and len(i) > 1]
                asked = words(query)
                known = set(asked)
                rest = [[w for w in ws if w not in known] for _, ws in items]
                for (kind, ws), new in zip(items[:-1], rest):
                    if ws:
                        inside.setdefault(kind, Counter()).update(new)
                        if ws[-1] not in known:
                            ending.setdefault(kind, Counter())[ws[-1]] += 1
                every = [w for ws in rest for w in ws]
                if lang := _seeded(every, known):
                    spoken[lang][RECORDS] += 1
                    spoken[lang].update(known)
                    spoken[lang].update(every)
                topic = _topic(asked, _SEEDS)
                if topic and any(ws for _, ws in items):
                    side = cues["nowhere" if topic.isdisjoint([w for _, ws in items for w in ws]) else "there"]
                    side[RECORDS] += 1
                    side.update(set(every))
            rows = [("lang", k, w, n, 0) for k, c in spoken.items() for w, n in c.items() if not w.isdigit()] + [("cue", k, w, n, 0) for k, c in cues.items() for w, n in c.items()]
            for kind, c in inside.items():
                ends = ending.get(kind, Counter())
                rows += [("end", kind, "0" if w.isdigit() else w, n, ends.get(w, 0)) for w, n in c.items()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(),) * 3 + (pa.int64(),) * 2)], names=["what", "of", "word", "n", "ends"])

    return records.select("query", "output").mapInArrow(run, "what string, of string, word string, n long, ends long").groupBy("what", "of", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def tail_of(output: list | None) -> tuple[str, str] | None:
    """(kind, last word) of a response; digits stand for each other."""
    for i in reversed(output or []):
        if i and len(i) > 1 and i[1]:
            ws = words(i[1])
            if ws:
                return i[0] or "", "0" if ws[-1].isdigit() else ws[-1]
    return None


class Features:
    """What the field sees of a clause."""

    NAMES = ("bias", "is the query", "words of the query", "place of the query", "no cue of declining", "one", "two or more", "cues without the place", "language differs", "language agrees", "last", "last, open end", "last, open end rarely so", "last, word cut", "last, phrase cut", "long lead-in", "last, closed", "nothing of the query in the response", "nothing of the query")

    def __init__(self, langs: dict[str, dict[str, int]], totals: dict[str, int], n: int, cues: set[str], how: PairModel):
        """langs: {word: {language: occurrences}} of the spoken words, totals of all words, n records."""
        spoken = set(langs)
        #: Words in so many of all records belong to a language; those in more are common. Shares, so that names stay names in a table of any size.
        self.common = {w for w in spoken if sum(langs[w].values()) >= how.common * n}
        self.cues = cues
        known = list(spoken | (set(_SEEDS) - spoken))
        self.row = {w: i + 1 for i, w in enumerate(known)}
        table = np.zeros((len(known) + 1, len(FUNCTION_WORDS)))
        for w in known:
            by = langs[w] if w in spoken else dict.fromkeys(_SEEDS[w], 50)
            table[self.row[w]] = [math.log((by.get(k, 0) + 0.5) / (totals.get(k, 0) + 1)) for k in FUNCTION_WORDS]
        self.logs = table

    def languages(self, texts: list[list[str]]) -> np.ndarray:
        """Log-likelihood of each text's words per language, by words that the statistics know; zeros where none is."""
        ids = [[r for w in ws if (r := self.row.get(w))] for ws in texts]
        out = np.zeros((len(texts), self.logs.shape[1]))
        some = [i for i, x in enumerate(ids) if x]
        if some:
            starts = np.cumsum([0] + [len(ids[i]) for i in some[:-1]])
            out[some] = np.add.reduceat(self.logs[[r for i in some for r in ids[i]]], starts, axis=0)
        return out

    def clauses(self, output: list | None) -> list[tuple[str, str, bool, list[str]]]:
        """(kind, text, whether it is the end of the response, words) of all clauses with a letter or digit."""
        out: list[tuple[str, str, bool, list[str]]] = []
        for item in output or []:
            if not item or len(item) < 2 or not item[1]:
                continue
            text = item[1].strip()
            merged: list[tuple[str, list[str]]] = []
            for p in _CLAUSE.split(text):
                ws = words(p)
                if ws and merged and all(w.isdigit() for w in ws):
                    merged[-1] = (merged[-1][0] + " " + p, merged[-1][1] + ws)
                elif ws:
                    merged.append((p, ws))
            out += [(item[0] or "", p, False, ws) for p, ws in merged]
        if out:
            out[-1] = (*out[-1][:2], True, out[-1][3])
        return out

    def rows(self, records: list[tuple]) -> list[tuple[np.ndarray, list[int]]]:
        """(clauses x features, words per clause) of each record (query, output, {(kind, last word): (occurrences, at the end)})."""
        asked = [words(q) for q, *_ in records]
        parts = [self.clauses(o) for _, o, *_ in records]
        sets = [set(a) for a in asked]
        best = self._best(asked)
        theirs = self._best([[w for w in ws if w not in known] for known, cs in zip(sets, parts) for *_, ws in cs])
        every: list[list[float]] = []
        for a, known, cs, own, (_, _, tails) in zip(asked, sets, parts, best, records):
            every += self._record(a, known, cs, own, theirs[len(every) : len(every) + len(cs)], tails)
        x, out, at = np.array(every).reshape(-1, len(self.NAMES)), [], 0
        for cs in parts:
            out.append((x[at : at + len(cs)], [len(c[3]) for c in cs]))
            at += len(cs)
        return out

    def _best(self, texts: list[list[str]]) -> list[tuple[bool, int, list[float]]]:
        """Per text: whether the statistics know a word of it, its likeliest language, and all likelihoods."""
        x = self.languages(texts)
        return list(zip(x.any(axis=1).tolist(), x.argmax(axis=1).tolist(), x.tolist()))

    def _record(self, asked: list[str], known: set[str], clauses: list, mine: tuple, theirs: list[tuple], tails: dict) -> list[list[float]]:
        joined = "".join(asked)
        x = []
        topic = _topic(asked, self.common)
        nowhere = float(bool(topic) and all(topic.isdisjoint(ws) for *_, ws in clauses))
        spoken, q, mine = mine
        for (kind, text, end, ws), (there, best, other) in zip(clauses, theirs):
            row = [0.0] * len(self.NAMES)
            x.append(row)
            row[0], row[17] = 1.0, nowhere
            flat = "".join(ws)
            if joined and joined in flat:
                front, _, back = flat.partition(joined)
                lead, n = 0, 0
                while n < len(front):
                    n += len(ws[lead])
                    lead += 1
                if not back.replace(joined, ""):
                    row[1 if lead <= 2 else 15] = 1
            row[2] = len([1 for w in ws if w in known]) / len(ws)
            place = len([1 for w in ws if w in topic]) if topic else 0
            row[3] = min(1.0, place / 2) if asked else 1.0
            cues = len(self.cues.intersection(ws))
            row[4 + min(cues, 2)] = 1
            row[7] = float(cues >= 1 and row[3] == 0)
            row[18] = float(row[3] == 0)
            if not spoken:
                row[9] = 1  # nothing to disagree with
            elif there:
                sure = min(1.0, (mine[q] - mine[best]) / 3)  # a query that may be in either language disagrees with neither
                if best != q and sure >= 0.5:
                    row[8] = min(1.0, (other[best] - other[q]) / 4)
                else:
                    row[9] = 1
            if end:
                row[10] = 1
                closed = bool(_DONE.search(text)) and not re.search(r",[”\"»]\s*$", text)
                row[16] = float(closed)
                if not closed:
                    row[11] = 1
                    self._open_end(row, ws[-1], kind, asked, known, clauses, tails)
        return x

    def _open_end(self, row: list[float], w: str, kind: str, asked: list[str], known: set[str], clauses: list, tails: dict) -> None:
        """Whether an open end breaks off: by what follows its last word elsewhere in the record and how often the word ends items of its kind."""
        seqs = [asked] + [ws for *_, end, ws in clauses if not end]
        n, e = tails.get((kind, "0" if w.isdigit() else w), (0, 0))
        if not w.isdigit() and any(w in seq for seq in seqs):
            after = Counter(b for seq in seqs for a, b in zip(seq, [*seq[1:], ""]) if a == w)
            if w in known and w not in self.common:  # inside a name that the query and an item have in full
                row[14] = float(len(after) == 1 and all(b in known and m > 1 for b, m in after.items()))
            elif w not in known and n:
                row[12] = float(e < 0.02 * n and "" not in after)
        else:
            row[12] = float(n == 0 or e < 0.02 * n)
            row[13] = float(n == 0 and not w.isdigit())


class Field:
    """A linear-chain conditional random field over padded batches."""

    def __init__(self, n_features: int):
        self.w = np.zeros((n_features, len(TAGS)))
        self.t = np.zeros((len(TAGS), len(TAGS)))

    @staticmethod
    def _pad(seqs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(seqs), max(map(len, seqs), default=0)
        x, m = np.zeros((n, most, width)), np.zeros((n, most), bool)
        for i, s in enumerate(seqs):
            x[i, : len(s)], m[i, : len(s)] = s, True
        return x, m

    @staticmethod
    def _sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

    def fit(self, seqs: list[np.ndarray], tags: list[list[int]], rounds: int, rate: float) -> Field:
        """Maximum likelihood by gradient steps with adaptive rates; exact expectations by forward and backward sums."""
        x, mask = self._pad(seqs, self.w.shape[0])
        y, _ = self._pad([np.array(t, float)[:, None] for t in tags], 1)
        y = y[:, :, 0].astype(int)
        n, most, _ = x.shape
        gold = np.eye(len(TAGS))[y] * mask[:, :, None]
        flat = x.reshape(-1, x.shape[2])
        g2w, g2t = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(rounds):
            s = (flat @ self.w).reshape(n, most, -1)
            a, b = np.zeros_like(s), np.zeros_like(s)
            a[:, 0] = s[:, 0]
            for i in range(1, most):
                step = self._sum(a[:, i - 1, :, None] + self.t[None], 1) + s[:, i]
                a[:, i] = np.where(mask[:, i, None], step, a[:, i - 1])
            for i in range(most - 2, -1, -1):
                step = self._sum(self.t[None] + (s[:, i + 1] + b[:, i + 1])[:, None, :], 2)
                b[:, i] = np.where(mask[:, i + 1, None], step, 0)
            z = self._sum(a[:, -1], 1)
            p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
            gw = flat.T @ (gold - p).reshape(-1, len(TAGS)) / n - 1e-4 * self.w
            gt = -1e-4 * self.t
            for i in range(1, most):
                both = np.exp(a[:, i - 1, :, None] + self.t[None] + (s[:, i] + b[:, i])[:, None, :] - z[:, None, None]) * mask[:, i, None, None]
                gt = gt + (gold[:, i - 1].T @ gold[:, i] - both.sum(0)) / n
            g2w, g2t = g2w + gw**2, g2t + gt**2
            self.w = self.w + rate * gw / np.sqrt(g2w)
            self.t = self.t + rate * gt / np.sqrt(g2t)
        return self

    def tag(self, seqs: list[np.ndarray]) -> list[list[int]]:
        """The likeliest tags of each sequence."""
        if not seqs:
            return []
        x, mask = self._pad(seqs, self.w.shape[0])
        n, most, _ = x.shape
        if not most:
            return [[] for _ in seqs]
        s = x @ self.w
        best, back = s[:, 0], np.zeros((n, most, len(TAGS)), int)
        for i in range(1, most):
            all_ = best[:, :, None] + self.t[None]
            back[:, i] = np.where(mask[:, i, None], all_.argmax(1), np.arange(len(TAGS)))
            best = np.where(mask[:, i, None], all_.max(1) + s[:, i], best)
        at = best.argmax(1)
        path = np.zeros((n, most), int)
        for i in range(most - 1, -1, -1):
            path[:, i] = at
            at = back[np.arange(n), i, at]
        return [path[i, : len(q)].tolist() for i, q in enumerate(seqs)]


def subject(query: str, items: list) -> list[str]:
    """The longest run of the query's words that at least half of the items repeat: what they are about."""
    asked, texts = words(query), [f" {' '.join(words(i[1]))} " for i in items]
    for n in range(len(asked), 0, -1):
        for i in range(len(asked) - n + 1):
            if 2 * sum(f" {' '.join(asked[i : i + n])} " in t for t in texts) >= len(texts):
                return asked[i : i + n]
    return []


def made_pairs(rows: list[tuple], feats: Features, seed: int = 7) -> list[tuple[str, list, int, bool]]:
    """Labelled training pairs (query, items, tag, whether only the last clause has it) from records that are nearly all sound: each as it is, and with one made defect. A response that takes up no topic of its query counts as declining."""
    rng = np.random.default_rng(seed)
    sound, made = [], []
    for q, o in rows:
        items = [[i[0], i[1]] for i in o or [] if i and len(i) > 1 and words(i[1])]
        asked = words(q)
        topic = _topic(asked, feats.common)
        if topic and items and topic.isdisjoint([w for i in items for w in words(i[1])]):
            made.append((q, items, REFUSAL, False))
        elif q and asked and len(items) >= 2:
            sound.append((q, items, _seeded([w for i in items for w in words(i[1])], set(asked))))
    tongues = list(FUNCTION_WORDS)
    spoken = feats.languages([words(q) for q, *_ in sound])
    for k, (q, items, lang) in enumerate(sound):
        asks = tongues[int(spoken[k].argmax())] if spoken[k].any() else lang
        if lang and lang == asks:
            made.append((q, items, ANSWER, False))
        few = items[: int(rng.integers(1, len(items) + 1))]
        kind = k % 4
        if kind == 0:
            last = few[-1][1]
            inside = [m.end() for m in re.finditer(r"\w(?=\w)", last)][len(last) // 5 :]
            between = [m.end() for m in re.finditer(r"\w(?=[^\w.!?]+\w)", last)][1:]
            made += [(q, [*few[:-1], [few[-1][0], last[: int(rng.choice(cut))]]], UNFINISHED, True) for cut in filter(None, (inside, between))]
        elif kind == 1:
            pool = REFUSALS[lang or "en"]
            made.append((q, [[i[0], " ".join(rng.choice(pool, int(rng.integers(1, 3))))] for i in few], REFUSAL, False))
        elif kind == 2:
            styles = (str, str.upper, str.title, lambda s: s + "?", lambda s: f"“{s}”", lambda s: f"{s} {s}")
            made.append((q, [[i[0], str(rng.choice(LEAD_INS)) + styles[int(rng.integers(len(styles)))](q)] for i in few], ECHO, False))
        else:
            for other, theirs, tongue in (sound[(k + d) % len(sound)] for d in range(1, 40)):
                if tongue and asks and tongue != asks:
                    away, here = subject(other, theirs), subject(q, items)
                    if away and here:
                        swap = re.compile(r"[\W_]+".join(map(re.escape, away)), re.I)
                        made.append((q, [[i[0], swap.sub(" ".join(here), i[1])] for i in theirs], FOREIGN, False))
                        break
    return made


def labelled(made: list[tuple], feats: Features, tails: dict) -> tuple[list[np.ndarray], list[list[int]]]:
    """Features and tags of made pairs; of the cut ones, those whose end shows it, as what is left of the others may well be a whole."""
    seqs, tags = [], []
    for (x, _), (_, _, tag, only_last) in zip(feats.rows([(q, o, tails) for q, o, *_ in made]), made):
        if len(x) and (tag != UNFINISHED or x[-1][12:15].any()):
            seqs.append(x)
            tags.append([ANSWER] * (len(x) - 1) + [tag] if only_last else [tag] * len(x))
    return seqs, tags


def defect_of(tags: list[int], sizes: list[int]) -> str | None:
    """The one defect of a response: of its clauses' words, all decline or all repeat, most are foreign, or the last is cut off."""
    if not tags:
        return "empty"
    total = sum(sizes)
    part = lambda t: sum(s for x, s in zip(tags, sizes) if x == t) / total
    if part(REFUSAL) == 1:
        return "refusal"
    if part(ECHO) == 1:
        return "copy"
    if part(FOREIGN) > 0.5:
        return "other_language"
    return "truncated" if tags[-1] == UNFINISHED else None


def train(records: DataFrame, counts: DataFrame, how: PairModel = PairModel()) -> tuple[Features, Field]:
    """Statistics over all records and a field trained on pairs made from a bounded sample of them. Words reach the driver by shares of the records, so that at most (words of a record / share) do, in a table of any size."""
    sums = {(r["what"], r["of"]): (r["all"], r["n"]) for r in counts.groupBy("what", "of").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("word") == RECORDS, F.col("n")).otherwise(0)).alias("n")).where("what <> 'end'").collect()}  # a row per language and side
    n = sum(sums.get(("lang", k), (0, 0))[1] for k in FUNCTION_WORDS)
    lang = counts.where((F.col("what") == "lang") & (F.col("word") != RECORDS))
    langs = {r["word"]: {b["of"]: b["n"] for b in r["by"]} for r in lang.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("of", "n")).alias("by")).where(F.col("n") >= how.spoken * n).collect()}
    side = lambda k: F.sum(F.when(F.col("of") == k, F.col("n")).otherwise(0))
    (_, nowhere), (_, there) = sums.get(("cue", "nowhere"), (0, 0)), sums.get(("cue", "there"), (0, 0))
    odds = (F.col("a") + 0.5) / (nowhere + 1) / ((F.col("b") + 0.5) / (there + 1))
    cues = {r[0] for r in counts.where((F.col("what") == "cue") & (F.col("word") != RECORDS)).groupBy("word").agg(side("nowhere").alias("a"), side("there").alias("b")).where((F.col("a") >= max(1.0, how.cue * nowhere)) & (odds >= how.odds)).select("word").collect()}
    feats = Features(langs, {k: sums.get(("lang", k), (0, 0))[0] for k in FUNCTION_WORDS}, n, cues, how)
    some = records.where("query is not null and output is not null").select("record_id", "query", "output").orderBy(F.xxhash64("record_id"), "record_id").limit(how.sample).collect()
    made = made_pairs([(r["query"], r["output"]) for r in some], feats)
    ends = sorted({t for _, o, *_ in made if (t := tail_of(o))})  # one per made pair at most
    asked = records.sparkSession.createDataFrame(ends or [("", "")], "of string, word string")
    tails = {(r["of"], r["word"]): (r["n"], r["ends"]) for r in counts.where("what = 'end'").join(F.broadcast(asked), ["of", "word"]).collect()}
    seqs, tags = labelled(made, feats, tails)
    field = Field(len(Features.NAMES))
    return feats, (field.fit(seqs, tags, how.rounds, how.rate) if seqs else field)


def with_tails(records: DataFrame) -> DataFrame:
    """(record_id, query, output, _tail): records with the kind and word at the end of their response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = ["\t".join(t) if (t := tail_of(o)) else None for o in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails, pa.string())], names=["record_id", "query", "output", "_tail"])

    rows = records.select(F.col("record_id").cast("long").alias("record_id"), "query", F.col("output").cast("array<array<string>>").alias("output"))
    return rows.mapInArrow(run, "record_id long, query string, output array<array<string>>, _tail string")


def defects(records: DataFrame, how: PairModel = PairModel()) -> DataFrame:
    """(record_id, defect, tags): every defective record with its one defect and the tags of its clauses.

    records (record_id, query, output), output an array of [kind, text]. A
    null output, and one without a letter or digit, is 'empty'. Without a
    query no response is a copy or in another language. Repeated rows give
    repeated results. Of the word at its end, each record gets the statistics
    by a join, in which words that end many records stay where they are.
    """
    counts = materialize(statistics(records), "pairs")
    shared = records.sparkSession.sparkContext.broadcast(train(records, counts, how))  # words by shares of the records
    rows = with_tails(records)
    ends = counts.where("what = 'end'").select(F.concat_ws("\t", "of", "word").alias("_tail"), "n", "ends")
    joined = lookup_join(rows, ends, "_tail", hot_keys(rows.select("_tail"), "_tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats, field = shared.value
        for b in batches:
            ids, found = b.column(0).to_pylist(), []
            tails = [{tuple(t.split("\t", 1)): (n, e)} if t is not None and n is not None else {} for t, n, e in zip(*[b.column(c).to_pylist() for c in (3, 4, 5)])]
            rows = feats.rows(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), tails)))
            for i, (_, sizes), tags in zip(ids, rows, field.tag([x for x, _ in rows])):
                if d := defect_of(tags, sizes):
                    found.append((i, d, [TAGS[t] for t in tags]))
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string()))], names=["record_id", "defect", "tags"])

    return joined.select("record_id", "query", "output", "_tail", "n", "ends").mapInArrow(run, "record_id long, defect string, tags array<string>")
