"""Future-sampling policies and their window rules against worked cases."""

from tamarack.streaming import sampling
from tamarack.streaming.policies import READ, WRITE


def forced(source, committed):
    return committed + sampling.squeeze(source)[len(committed) :]


def rest(source, committed):
    return sampling.squeeze(source)[len(committed) :]


def test_sentence_offset():
    f = sampling.sentence_offset
    assert f("", "abc", "") == f("abc", "", "abc") == f(None, None, None) == 0
    assert f("abcdefXYZ", "abcdef", "") == 6
    assert f("Qbcdefgh.next", "abcdefgh.", "") == 9  # the suffix of eight is found, the prefix isn't shared
    assert f("Qbcde.next", "abcde.", "") == 0  # five characters are no anchor
    assert f("zzzzzzzzzz", "abcdefgh", "abc") == 3


def test_aligned_prefix():
    f = sampling.aligned_prefix
    t = "0123456789abcdefghij"
    assert f(4, 0, t, [(0, 3)]) == "" and f(4, 2, "", [(0, 3)]) == ""
    assert f(4, 2, t, [(1, 4), (1, 6), (1, 9)]) == t[:7]
    assert f(4, 1, t, [(0, 12)]) == t[:5]  # five characters a word
    assert f(4, 2, t, [(0, 3), (1, 1)]) == t[:4]  # too early: the last link of any word heard
    assert f(4, 2, t, [(0, 3), (1, 2), (1, 16)]) == t[:10]  # too far apart
    assert f(4, 2, t, [(3, 5)]) == t[:8]  # no link: 0.8 of half
    assert f(0, 2, t, []) == ""


def test_aligned_quorum():
    """Words are single characters of the target, each aligned to itself; hypotheses part after what was heard."""

    def align(pairs):
        return [[(k, near.find(w)) for k, w in enumerate(heard.split()) if w in near] for heard, near in pairs]

    def make(**kw):
        return sampling.AlignedQuorum(lambda o: ["x y z u v w", "p q r s t u", "m n o w k l"], forced, rest, align, **kw)

    chunks = ["a b c d", "", "e f g h", "i j"]
    assert make().run(chunks) == [(WRITE, "abcd"), (READ, ""), (WRITE, "efgh"), (WRITE, "ij")]
    # a model's pick is believed as far as the quorum goes; what is too short or repeats itself is read
    assert make(pick=lambda o, c, cuts, out: out[:2] + "Z").run(chunks)[0] == (WRITE, "ab")
    assert make(pick=lambda o, c, cuts, out: "").run(chunks)[0] == (READ, "")
    assert make(least_chars=5).run(chunks)[0] == (READ, "")
    assert make(least_words=5).run(chunks)[0] == (READ, "") and make(least_words=5).run(chunks)[2] == (WRITE, "abcdefgh")
    twice = sampling.AlignedQuorum(lambda o: ["x", "y"], forced, rest, lambda pairs: [[(k, k) for k in range(len(heard.split()))] for heard, _ in pairs])
    assert twice.run(["a b c a b c", "z"])[0] == (READ, "") and twice.run(["a b c a b d g", "z"])[0] == (WRITE, "abcabdg")  # near the end: the last link of any word heard, here the same


def test_safe_delta_drops_what_no_future_covers():
    none = sampling.SafeDelta(lambda o: ["x", "y"], lambda o, f, c: rest(o, c), rest, lambda pairs: [[] for _ in pairs])
    assert none.run(["ab cd", "ef"]) == [(READ, ""), (WRITE, "abcdef")]
    few = sampling.SafeDelta(lambda o: ["x"], lambda o, f, c: rest(o, c), rest)
    assert few.run(["ab cd", "ef"])[0] == (READ, "")


def test_votes_of_futures():
    # two of three hypotheses agree for two tokens; the third parts at once
    adds = {"f1": "ABC", "f2": "ABD", "f3": "XYZ"}
    translate = lambda source, committed: committed + adds[source.split()[-1]]
    encode, decode = lambda t: list(map(ord, t)), lambda ids: "".join(map(chr, ids))
    vote = sampling.MedoidVote(lambda o: list(adds), translate, rest, lambda ts: [[1, t.count("A")] for t in ts], encode, decode, lambda o, c, ids: [(-0.5, 0.1)] * len(ids), threshold=0.6)
    assert vote.run(["q", "r"])[0] == (WRITE, "AB")
    unsure = sampling.MedoidVote(lambda o: list(adds), translate, rest, lambda ts: [[1, t.count("A")] for t in ts], encode, decode, lambda o, c, ids: [(-0.5, 2.0)] * len(ids), threshold=0.6)
    assert unsure.run(["q", "r"])[0] == (READ, "")
    cluster = sampling.ClusterTrie(lambda o: list(adds), translate, rest, lambda ts: [[1.0, 0.0] if t[0] == "A" else [0.0, 1.0] for t in ts])
    assert cluster.run(["q", "r"])[0] == (WRITE, "AB")
    wide = sampling.ClusterTrie(lambda o: list(adds), translate, rest, lambda ts: [[1.0, 0.0] if t[0] == "A" else [0.0, 1.0] for t in ts], least_share=0.9)
    assert wide.run(["q", "r"])[0] == (READ, "")
    assert sampling.quorum_share(["abc", "abd", "x"], 2) == "ab" and sampling.quorum_share(["a"], 2) == "" and sampling.quorum_share([], 1) == ""
