"""Toxicity by compression distance: windows are compressed under an ordinary and a toxic zstandard dictionary."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import labelled_sample
from .quality import scored


#: One word in so many ends a window.
MARKER = 12


def headed(word: str) -> str:
    """A lower-case word with its first three letters in capitals, so that a beginning doesn't match the inside of a word."""
    return word[:3].upper() + word[3:]


def windows(text: str, size: int) -> list[bytes]:
    """The whole text, words ``headed``, cut between words into windows of at most about ``size`` bytes.

    One word in ``MARKER``, by its hash, ends a window as well: so a passage has the same windows wherever it stands.
    """
    out, held, n = [], [], 0
    for word in text.lower().split():
        held.append(word[:3].upper() + word[3:])
        n += len(word) + 1
        if n > size or zlib.crc32(word.encode("utf-8", "replace")) % MARKER == 0:
            out.append(" ".join(held).encode("utf-8", "replace"))
            held, n = [], 0
    if held:
        out.append(" ".join(held).encode("utf-8", "replace"))
    return out


#: Windows in a row whose savings are added up; the worst run of each length decides.
RUNS = (1, 2, 6, 24, 96, 1 << 30)
#: Windows whose vocabulary settles together which pair of dictionaries they are held against.
STRETCH = 24
#: Ends a dictionary: zstandard doesn't look matches up that begin in its last bytes.
TAIL = b"\0" * 32
#: Both compressors get this part of the shared dictionary before a window and a few bytes after it: zstandard stores what
#: is too short to gain as it is, and looks for no matches in the last bytes.
LEAD, END = slice(8000, 8032), b"\0" * 10
_LETTERS = re.compile(r"[^\W\d_]+").findall


class _Pair:
    """The compressors of an ordinary and a toxic dictionary, and a logistic curve over what the toxic one saves."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int):
        self.ordinary, self.toxic, self.level = ordinary, toxic, level
        self.mean = self.spread = 0.0
        self.curve = np.zeros(1 + len(RUNS))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def saved(self, held: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window, nothing at the least."""
        if "tools" not in self.__dict__:
            self.tools = self._compressor(self.ordinary).compress, self._compressor(self.toxic).compress
        plain, toxic = self.tools
        lead = self.ordinary[LEAD] + b" "
        return np.array([max(0, len(plain(x)) - len(toxic(x))) for x in (lead + w + END for w in held)], float)

    def features(self, saved: np.ndarray) -> list[float]:
        """A constant, and for each length of RUNS how far the worst run of so many windows stands over ordinary ones.

        In standard deviations of ordinary text, less what the worst of as many runs has by chance: so a passage in a
        long text loses little by what stands around it, and a long text doesn't gain by its length alone.
        """
        upto, out = np.concatenate([[0], np.cumsum(saved)]), [1.0]
        for n in RUNS:
            n = min(n, len(saved))
            most = float((upto[n:] - upto[: len(upto) - n]).max()) if n else 0.0
            out.append(max(0.0, (most - self.mean * n) / math.sqrt(self.spread * max(n, 1) + 1) - math.sqrt(2 * math.log(max(1.0, len(saved) / max(n, 1))))))
        return out


class Gauge:
    """Pairs of dictionaries, one for each group of like vocabulary, each with its own threshold; the worst part of a text decides."""

    def __init__(self, places: dict[str, int], hearts: np.ndarray, pairs: list[_Pair], size: int):
        self.places, self.hearts, self.pairs, self.size = places, hearts, pairs, size

    def parts(self, text: str) -> list[tuple[int, list[bytes]]]:
        """(group, windows) of a whole text: stretches of windows, neighbours of one group put together."""
        held, out = windows(text, self.size), []
        cuts = [*range(0, max(1, len(held) - STRETCH // 2), STRETCH), len(held)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            group = _nearest(b" ".join(held[a:b]).decode("utf-8").lower(), self.places, self.hearts)
            if out and out[-1][0] == group:
                out[-1][1].extend(held[a:b])
            else:
                out.append((group, held[a:b]))
        return out

    def score(self, text: str) -> float:
        worst = max(float(self.pairs[g].curve @ self.pairs[g].features(self.pairs[g].saved(held))) for g, held in self.parts(text))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, worst))))


def _nearest(text: str, places: dict[str, int], hearts: np.ndarray) -> int:
    """The group whose common words the text has most of; the first if it has none."""
    at = [i for w in set(_LETTERS(text)) if (i := places.get(w)) is not None]
    return int(np.argmax(hearts[:, at].sum(1))) if at else 0


def _kmeans(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 15) -> tuple[float, np.ndarray]:
    """How alike rows of length one are to their centers, all added up, and those centers."""
    hearts = [x[rng.integers(len(x))]]
    for _ in range(count - 1):
        away = np.clip(1 - np.max(x @ np.array(hearts).T, axis=1), 0, None) ** 2 + 1e-12
        hearts.append(x[rng.choice(len(x), p=away / away.sum())])
    hearts = np.array(hearts)
    for _ in range(rounds):
        of = np.argmax(x @ hearts.T, axis=1)
        hearts = np.array([x[of == k].sum(0) if (of == k).any() else hearts[k] for k in range(count)])
        hearts /= np.maximum(np.linalg.norm(hearts, axis=1), 1e-9)[:, None]
    return float((x @ hearts.T).max(1).sum()), hearts


def _groups(sample: list[tuple[str, int]], seed: int, count: int = 6, common: int = 400, tries: int = 6, least: int = 8) -> tuple[dict[str, int], np.ndarray]:
    """Place of each common word, and the centers of groups of like vocabulary (so of language, mostly), the largest first.

    K-means over which common words a text has, rare ones weighing more. A group of under ``least`` toxic texts joins the one most like it.
    """
    # Most words are rare, so common ones are told by some of the texts, and only those are held of each.
    has = Counter(w for t, _ in sample[:1000] for w in set(_LETTERS(t.lower())))
    places = {w: i for i, w in enumerate(sorted(has, key=lambda w: (-has[w], w))[:common])}
    if len(sample) <= 10 * count or not places:
        return places, np.ones((1, len(places)))
    weight = np.log((1 + min(1000, len(sample))) / np.array([has[w] for w in places]))
    has.clear()
    x = np.zeros((len(sample), len(places)), np.float32)
    for i, (t, _) in enumerate(sample):
        x[i, [k for w in set(_LETTERS(t.lower())) if (k := places.get(w)) is not None]] = 1
    x *= weight
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    hearts = max((_kmeans(x, count, np.random.default_rng([seed, k])) for k in range(tries)), key=lambda found: found[0])[1]
    toxic = np.array([y for _, y in sample], int)
    while len(hearts) > 1:
        of = np.argmax(x @ hearts.T, axis=1)
        held = np.bincount(of, toxic, len(hearts))
        if held.min() >= least:
            break
        low = int(held.argmin())
        like = hearts @ hearts[low]
        like[low] = -1
        to = int(like.argmax())
        hearts[to] = x[(of == low) | (of == to)].sum(0)
        hearts[to] /= max(np.linalg.norm(hearts[to]), 1e-9)
        hearts = np.delete(hearts, low, 0)
    sizes = np.bincount(np.argmax(x @ hearts.T, axis=1), minlength=len(hearts))
    return places, hearts[np.argsort(-sizes, kind="stable")] * weight


def _stems(words: Counter, known: set[str] | None = None, most: int = 4) -> Counter:
    """Beginnings of words, four characters at least, and whole words between blanks, each with its count, but ``most`` at most.

    With ``known``, only those whose first ones are in it, each a character longer than one that is.
    """
    found: Counter = Counter()
    for w, n in words.items():
        if known is not None and w[:4] not in known:
            continue
        for k in range(4, min(len(w), 12) + 1):
            if known is not None and k > 4 and w[: k - 1] not in known:
                break
            found[w[:k]] += n
        found[f"{w} "] += n
    return Counter({w: min(n, most) for w, n in found.items()})


def _segments(sample: list[tuple[str, int]], lift: float, sure: float, share: float) -> list[str]:
    """Stems that stand in a ``share`` of the toxic texts and ``lift`` times as often as in as much ordinary text.

    The likelihood ratio (G) of both rates has to be at least ``sure``, too. Of stems that begin with one another the
    one that tells most is taken. A beginning is counted only if the one before it stands in as many texts, so few are held.
    """
    toxic, plain, n = Counter(), Counter(), [1, 1]
    bags = [Counter(t.lower().split()) for t, y in sample if y]
    asked = max(3, share * len(bags))
    known: set[str] = set()
    for k in range(4, 13):
        texts = Counter(s for bag in bags for s in {w[:k] for w in bag if len(w) >= k and (k == 4 or w[: k - 1] in known)})
        often = {s for s, c in texts.items() if c >= asked}
        known |= often
        if not often:
            break
    texts = Counter(w for bag in bags for w in bag if w[:4] in known or len(w) < 4)
    whole = {f"{w} " for w, c in texts.items() if c >= asked}
    wanted = known | whole
    for bag in bags:
        n[1] += bag.total()
        toxic.update({w: c for w, c in _stems(bag, known | {w.strip()[:4] for w in whole}).items() if w in wanted})
    heads = {w.strip()[:4] for w in wanted}
    for t, y in sample:
        if not y:
            bag = Counter(t.lower().split())
            n[0] += bag.total()
            plain.update({w: c for w, c in _stems(Counter({w: c for w, c in bag.items() if w[:4] in heads}), known | heads).items() if w in wanted})
    toxic = Counter({f" {w}": c for w, c in toxic.items()})
    plain = Counter({f" {w}": c for w, c in plain.items()})
    found: dict[str, float] = {}
    for w, k in toxic.items():
        z = plain[w]
        if k / n[1] >= lift * (z + 0.5) / n[0]:
            p = (k + z) / (n[0] + n[1])
            ratio = 2 * sum(a * math.log(a / e) for a, e in ((k, n[1] * p), (z, n[0] * p)) if a)
            if ratio >= sure:
                found[w] = ratio
    taken: list[str] = []
    for w in sorted(found, key=lambda w: (-found[w] * (1 + len(w) / 50), w)):  # the longer of about equals saves more
        if not any(w.startswith(t) or t.startswith(w) for t in taken):
            taken.append(w)
    return taken[::-1]


def _padded(content: bytes) -> bytes:
    """To a multiple of three bytes: zstandard's tables surely hold each third position of a dictionary, later ones first."""
    return content + b" " * (-len(content) % 3)


def _dictionaries(sample: list[tuple[str, int]], known: list[str], base: int, lift: float, sure: float, share: float, seed: int) -> tuple[bytes, bytes]:
    """Contents of both: trained on ordinary windows without toxic segments, and after that as many bytes of segments of either side.

    The ordinary side's segments are its commonest words. With the same base in both, chance matches of ordinary
    words cancel out in the difference.
    """
    marks = _segments(sample, lift, sure, share)
    marks = [k for k in known if not any(m.startswith(k) or k.startswith(m) for m in marks)] + marks
    drop = [headed(m.strip()).encode("utf-8", "replace") for m in marks]
    toxic = b"".join(_padded(b" " + d + b" " * m.endswith(" ")) for d, m in zip(drop, marks, strict=True))
    words = Counter(w for t in [t for t, y in sample if not y][:500] for w in set(t.lower().split()))
    common = " ".join(headed(w) for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:20_000] if not any(f" {w} ".startswith(m) for m in marks)).encode("utf-8", "replace")
    picks = random.Random(seed)
    ordinary = [w for cut in (windows(t, 256) for t, y in sample if not y) for w in picks.sample(cut, min(len(cut), 8))]
    picks.shuffle(ordinary)
    ordinary = [w for w in ordinary[:20_000] if not any(m in w for m in drop)]
    try:
        trained = zstandard.train_dictionary(base, ordinary).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        trained = b" ".join(ordinary)[-base:]
    trained = _padded(trained)
    shared = trained + _padded(common[:4096])
    return shared + b"\0" * len(toxic) + TAIL, shared + toxic + TAIL


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for the logistic curve; the constant is not held back."""
    w, hold = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w = w + np.linalg.solve((x.T * (p * (1 - p))) @ x + hold, x.T @ (y - p) - hold @ w)
    return w


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic curve without weights below zero: what is saved can only raise a score."""
    held = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[held] = _logistic(x[:, held], y)
        low = min(held[1:], key=lambda i: w[i], default=0)
        if not low or w[low] >= 0:
            return w
        held.remove(low)


def fit(sample: list[tuple[str, int]], threshold: float = 0.7, alarms: float = 0.005, size: int = 96, base: int = 16_384, level: int = 6, lift: float = 5.0, sure: float = 40.0, share: float = 0.15, folds: int = 4, seed: int = 0) -> Gauge:
    """For each group of like vocabulary a pair of dictionaries from all its texts; the curve from savings under dictionaries of the other ``folds``.

    So no text judges itself. The curve's constant is then set so that at most a share ``alarms`` of the group's ordinary texts
    comes over ``threshold``, under the dictionaries of the other folds as well as under those of all texts. A sample of one label only gives about that label for
    every text; an empty one gives 0.5.
    """
    order = list(sample)
    random.Random(seed).shuffle(order)
    places, hearts = _groups(order, seed)
    gauge = Gauge(places, hearts, [], size)
    of = [_nearest(" ".join(t.lower().split()), places, hearts) for t, _ in order]
    known = [_segments([t for i, t in enumerate(order) if i % folds != h], lift, sure, share) for h in range(folds)] + [_segments(order, lift, sure, share)]
    for g in range(len(hearts)):
        own = [(i % folds, *order[i]) for i in range(len(order)) if of[i] == g]
        found, y = [], [0.5]
        for h in range(folds):
            pair = _Pair(*_dictionaries([(t, k) for f, t, k in own if f != h], known[h], base, lift, sure, share, seed), level)
            found += [pair.saved(windows(t, size)) for f, t, _ in own if f == h]
            y += [float(k) for f, _, k in own if f == h]
        whole = [(t, k) for _, t, k in own]
        pair = _Pair(*_dictionaries(whole, known[-1], base, lift, sure, share, seed), level)
        plain = np.concatenate([np.zeros(1), *(v for v, k in zip(found, y[1:], strict=True) if not k)])
        pair.mean, pair.spread = float(plain.mean()), float(plain.var())
        x = [[1.0] + [0.0] * len(RUNS)] + [pair.features(v) for v in found]
        pair.curve = _rising(np.array(x), np.array(y))
        if (pair.curve[1:] > 0).any():
            over = np.array(x[1:]) @ pair.curve - pair.curve[0], [pair.curve[1:] @ pair.features(pair.saved(windows(t, size)))[1:] for t, k in whole if not k]
            plain = [np.sort(v) for v in (over[0][np.array(y[1:]) == 0], np.array(over[1])) if len(v)]
            worst = max(v[-1 - int(alarms * len(v))] for v in plain) if plain else 0.0
            # Few texts may not show so small a share: where the curve itself is more careful, it stands.
            pair.curve[0] = min(pair.curve[0], math.log(threshold / (1 - threshold)) - worst - 1e-6)
        gauge.pairs.append(pair)
    return gauge


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_toxic: int = 1200, max_ordinary: int = 3000, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) with held_out, score in 0..1 and predicted (1: toxic) of every row, from its whole text alone.

    Learns on the driver from at most ``max_toxic`` and ``max_ordinary`` labelled rows that are not held out (see
    labelled_sample); scores need no shuffle. Null texts count as empty and have a score too; null ids and repeated rows
    keep their rows; a null label is no label, and neither are labels of one id that disagree.
    """
    gauge = fit(labelled_sample(docs, labels, "toxic", {1: max_toxic, 0: max_ordinary}), threshold)
    return scored(docs, gauge.score, threshold, ["doc_id"] if keep is None else keep)
