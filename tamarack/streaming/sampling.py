"""Policies that sample futures of the source and commit what survives them (STR-09..16, WIN-18, WIN-19, WIN-23, WIN-24, AGG-34, AGG-50).

All of them read a chunk without words, too short a source or too few usable hypotheses; they differ in ``choose``, which
sees what the hypotheses add to the committed text. Models (sampling, translating, aligning, judging, embedding) are
injected callables, called once a step with the step's whole batch where they can take one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np

from tamarack.functions.prefixes import NOISE_PREFIXES, WORD_HEADS
from tamarack.operators.sequences import largest_cluster
from tamarack.operators.votes import trie_vote
from tamarack.streaming.policies import Policy, State, common_prefix

Pairs = Sequence[tuple[int, int]]

#: Target characters a heard word may stand for; how far its links may lie apart; margins at both ends of the target.
CHARS_A_WORD, SPREAD, FROM_END, FROM_START = 5, 12, 3, 2


def squeeze(text: str | None) -> str:
    """SCL-06 on the Python side: NFC without white space."""
    return "".join(unicodedata.normalize("NFC", text or "").split())


def aligned_prefix(total: int, observed: int, translation: str, pairs: Pairs) -> str:
    """WIN-18: the part of ``translation`` that stands for the ``observed`` first of ``total`` source words.

    It ends at the median link of the last word heard. Where that has no link, or links that lie far apart or close to an
    end of the translation, it ends at the last link of any word heard; without one, at 0.8 of the words' share (two
    characters or more). Aligned ends are capped by the number of words heard.
    """
    if observed <= 0 or not translation:
        return ""
    cap = max(2, CHARS_A_WORD * observed)
    last = sorted(t for s, t in pairs if s == observed - 1)
    if last and last[-1] - last[0] <= SPREAD and FROM_START <= last[len(last) // 2] <= len(translation) - FROM_END:
        return translation[: min(last[len(last) // 2] + 1, cap)]
    heard = max((t for s, t in pairs if s < observed), default=-1)
    if heard >= 0:
        return translation[: min(heard + 1, cap)]
    share = int(len(translation) * (observed / total) * 0.8) if total else 0
    return translation[:share] if share >= 2 else ""


def local_windows(full: str, observed: str, translation: str, committed: str, left: int = 40, right: int = 24, target_left: int = 120) -> tuple[str, str, str, int]:
    """WIN-19: (source, heard source, translation, offset of that in the whole one) around the end of what was heard."""
    words = full.split()
    heard = min(len(observed.split()), len(words))
    if not heard:
        return full, observed, translation, 0
    start, offset = max(0, heard - max(1, left)), max(0, len(committed) - max(0, target_left))
    near = translation[offset:]
    if len(near) < 8:
        near, offset = translation, 0
    return " ".join(words[start : heard + max(1, right)]), " ".join(words[start:heard]), near, offset


def sentence_offset(translation: str | None, before: str | None, committed: str | None, anchor: int = 6, slack: int = 64) -> int:
    """WIN-23: where a sentence begins in ``translation`` when ``before`` is what earlier sentences were expected to give.

    The furthest of: the prefix both share, what is committed, the end of the longest suffix of ``before`` (``anchor``
    characters or more) found in the translation's head.
    """
    t, b, c = translation or "", before or "", committed or ""
    if not t or not b:
        return 0
    limit = min(len(t), len(b) + max(0, slack))
    found = next((at + n for n in range(min(len(b), limit), max(1, anchor) - 1, -1) if (at := t.find(b[-n:], 0, limit)) >= 0), 0)
    return min(len(t), max(len(common_prefix([t, b])), min(len(t), len(b), len(c)), found))


def sentence_view(full: str, observed: str, start: int) -> tuple[str, str]:
    """WIN-24: the source and the heard source from word ``start`` on."""
    words = full.split()
    start = max(0, min(start, len(words)))
    return " ".join(words[start:]), " ".join(words[start : len(observed.split())])


def quorum_share(parts: list[str], k: int) -> str:
    """AGG-28 on the Python side: the longest prefix of ``k`` of the parts, the earliest part's where several are as long."""
    best = ""
    for p in parts:
        shared = sorted((len(common_prefix([p, q])) for q in parts), reverse=True)
        if 0 < k <= len(shared) and shared[k - 1] > len(best):
            best = p[: shared[k - 1]]
    return best


def one_direction(deltas: list[str], size: int = 3, ratio: float = 0.35) -> bool:
    """AGG-29 on the Python side: whether the most frequent opening holds ``ratio`` of the deltas."""
    keys = []
    for d in filter(None, map(str.strip, deltas)):
        key = re.sub("^(?:" + "|".join(NOISE_PREFIXES) + ")", "", re.sub(r"^[，。、；：！？\s]+", "", d))[:size]
        keys.append(key or d[:size])
    return bool(keys) and Counter(keys).most_common(1)[0][1] / len(keys) >= ratio


class FutureSampling(Policy):
    """``futures(observed)`` are continuations, ``translate(source, committed)`` whole hypotheses; hypotheses are squeezed.

    A hypothesis counts if it begins with what is committed. Fewer than ``least_words`` heard, ``least_futures`` sampled
    or ``least_valid`` hypotheses read the chunk, and so does a delta of under ``least_chars``.
    """

    def __init__(self, futures, translate, complete, least_words: int = 0, least_futures: int = 0, least_valid: int = 2, least_chars: int = 1):
        super().__init__(translate, complete)
        self.futures, self.least_words, self.least_futures, self.least_valid, self.least_chars = futures, least_words, least_futures, least_valid, least_chars

    def observed(self, s: State) -> str:
        return " ".join(filter(None, (c.strip() for c in s.chunks)))

    def hypotheses(self, observed: str, futures: list[str], committed: str) -> list[str]:
        return [squeeze(self.translate(f"{observed} {f}".strip(), committed)) for f in futures]

    def delta(self, s: State) -> str:
        observed = self.observed(s)
        if not s.chunks[-1].strip() or len(observed.split()) < self.least_words:
            return ""
        futures = list(self.futures(observed))
        if len(futures) < self.least_futures:
            return ""
        out = self.propose(observed, futures, s.committed)
        return out if len(out) >= self.least_chars else ""

    def propose(self, observed: str, futures: list[str], committed: str) -> str:
        adds = [h[len(committed) :] for h in self.hypotheses(observed, futures, committed) if h.startswith(committed)]
        return self.choose(observed, committed, adds, len(futures)) if len(adds) >= self.least_valid else ""

    def choose(self, observed: str, committed: str, adds: list[str], sampled: int) -> str:
        raise NotImplementedError


class MedoidVote(FutureSampling):
    """STR-09: tokens that ``threshold`` of the hypotheses have at each place, as far as the medoid hypothesis goes with
    them, cut at the first token whose log probability given the heard source alone is too low or too far from the best.

    ``embed(texts)`` gives vectors, ``encode``/``decode`` are the tokenizer's, ``score(observed, committed, ids)`` gives
    (log probability, margin) a token. Ties fall to what came first.
    """

    def __init__(self, futures, translate, complete, embed, encode, decode, score, threshold: float = 0.7, least_logp: float = -2.0, most_margin: float = 1.5, least_chars: int = 2, **limits):
        super().__init__(futures, translate, complete, least_chars=least_chars, **limits)
        self.embed, self.encode, self.decode, self.score = embed, encode, decode, score
        self.threshold, self.least_logp, self.most_margin = threshold, least_logp, most_margin

    def choose(self, observed, committed, adds, sampled):
        v = np.asarray(self.embed([committed + a for a in adds]), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        medoid = adds[int(np.argmax(np.round(v @ v.sum(axis=0), 9)))]
        lists, ids = [self.encode(a) for a in adds], []
        while votes := Counter(x[len(ids)] for x in lists if len(x) > len(ids)):
            token, n = votes.most_common(1)[0]
            if n / len(lists) < self.threshold:
                break
            ids.append(token)
        text = squeeze(self.decode(ids))
        if not medoid.startswith(text):
            text = common_prefix([text, medoid])
            ids = self.encode(text)
        safe = 0
        for logp, margin in self.score(observed, committed, ids) if text else []:
            if logp < self.least_logp or margin > self.most_margin:
                break
            safe += 1
        return squeeze(self.decode(ids[:safe])) if safe else ""


class ClusterTrie(FutureSampling):
    """STR-10: characters on which the largest cluster of hypotheses agrees; the vote is over the cluster if it holds
    ``least_share`` of what was sampled, else over all that was."""

    def __init__(self, futures, translate, complete, embed, threshold: float = 0.7, distance: float = 0.25, least_share: float = 0.5, least_chars: int = 2, **limits):
        super().__init__(futures, translate, complete, least_valid=1, least_chars=least_chars, **limits)
        self.embed, self.threshold, self.distance, self.least_share = embed, threshold, distance, least_share

    def choose(self, observed, committed, adds, sampled):
        adds = [a for a in adds if a]
        if not adds:
            return ""
        kept = [adds[k] for k in largest_cluster(np.asarray(self.embed(adds), float), self.distance)] if len(adds) > 1 else adds
        return trie_vote(kept, "", self.threshold, len(kept) if len(kept) >= self.least_share * sampled else sampled, self.least_chars)


class Judged(FutureSampling):
    """STR-11: as many characters of the translation of the heard source as ``judge(observed, committed, add, adds)`` calls safe."""

    def __init__(self, futures, translate, complete, judge: Callable[[str, str, str, list[str]], int], least_chars: int = 2, **limits):
        super().__init__(futures, translate, complete, least_chars=least_chars, **limits)
        self.judge = judge

    def choose(self, observed, committed, adds, sampled):
        plain = squeeze(self.translate(observed, committed))
        add = plain[len(committed) :] if plain.startswith(committed) else ""
        return add[: max(0, min(self.judge(observed, committed, add, adds), len(add)))] if add else ""


class AlignedQuorum(FutureSampling):
    """STR-12, STR-13: each hypothesis is cut where its alignment leaves the heard source; the cuts' quorum prefix is written.

    ``align([(source, target)])`` gives link lists. Of the cuts that add ``least_chars``, two or more must open alike;
    their longest prefix shared by ``ratio`` of them is the proposal (1.0 is plain agreement). ``pick(observed,
    committed, prefixes, proposal)`` may replace it (a voting model, or one that trims to a word boundary), and is
    believed as far as the quorum supports it. A delta that ends on a word's head or repeats itself is read.
    """

    def __init__(self, futures, translate, complete, align, ratio: float = 0.7, pick: Callable[[str, str, list[str], str], str] | None = None, least_chars: int = 2, **limits):
        super().__init__(futures, translate, complete, least_chars=least_chars, **limits)
        self.align, self.ratio, self.pick = align, ratio, pick

    def propose(self, observed, futures, committed):
        whole = self.hypotheses(observed, futures, committed)
        views = [local_windows(f"{observed} {f}".strip(), observed, h, committed) for f, h in zip(futures, whole, strict=True)]
        cuts = []
        for h, (source, heard, near, offset), links in zip(whole, views, self.align([(v[1], v[2]) for v in views]), strict=True):
            cut = h[: offset + len(aligned_prefix(len(source.split()), len(heard.split()), near, links))]
            if cut.startswith(committed) and len(cut) - len(committed) >= self.least_chars:
                cuts.append(cut)
        adds = [c[len(committed) :] for c in cuts]
        if len(adds) < 2 or not one_direction(adds):
            return ""
        k = max(1, math.ceil(self.ratio * len(adds)))
        out = quorum_share(adds, k)
        if self.pick:
            said = squeeze(self.pick(observed, committed, cuts, out))
            out = next((said[:n] for n in range(len(said), 0, -1) if sum(a.startswith(said[:n]) for a in adds) >= k), "")
        risky = re.search(f"[{WORD_HEADS}]$", out) or re.search(r"(.{3,8})\1", out, re.S)
        return "" if risky else out


class SafeDelta(FutureSampling):
    """STR-14..16: ``safe(observed, futures, committed)`` names the delta; with ``align`` it is cut to the shortest prefix
    that the alignment of some future still covers (AGG-34), and dropped where no future can be aligned."""

    def __init__(self, futures, safe: Callable[[str, list[str], str], str], complete, align=None, least_futures: int = 2, **limits):
        super().__init__(futures, None, complete, least_futures=least_futures, **limits)
        self.safe, self.align = safe, align

    def propose(self, observed, futures, committed):
        delta = squeeze(self.safe(observed, futures, committed))
        if not delta or not self.align or not futures:
            return delta
        target = committed + delta
        sources = [f"{observed} {f}".strip() for f in futures]
        cuts = []
        for source, links in zip(sources, self.align([(x, target) for x in sources]), strict=True):
            if links:
                cuts.append(max(len(committed), len(aligned_prefix(len(source.split()), len(observed.split()), target, links))))
        return target[len(committed) : min(cuts)] if cuts else ""
