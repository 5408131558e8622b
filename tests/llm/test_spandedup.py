import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import sha256

from rillmark.llm import spandedup as s
from rillmark.llm.queries import QUERIES

HASHES = s._Hashes()
STOP = "。"


def pieces(text):
    """(start, end) places of the pieces in characters, and their words, one window at a time."""
    words = [(m.start(), m.group()) for m in re.finditer(rf"[^ \t\n\x0b\x0c\r{STOP}]*{STOP}|[^ \t\n\x0b\x0c\r{STOP}]+", text)]
    low = [w.encode().lower() for _, w in words]
    first = [True] + [w.endswith((".", "!", "?", STOP)) or "\n" in text[at + len(w) : b] for (at, w), (b, _) in zip(words, words[1:], strict=False)]
    starts = [k for k, f in enumerate(first) if f] + [len(words)] if words else []
    own = [k for k, end in zip(starts, starts[1:], strict=False) if end - k >= s.SENTENCE or k == 0] + [len(words)]
    begins = set(own[:-1])
    for a, b in zip(own, own[1:], strict=False):
        for i in range(a, b - s.PIECE + 1):
            begins.add(min(range(i, i + s.PIECE), key=lambda j: (not first[j], HASHES[low[j]] >> 1 >> s.PLACE_BITS & (1 << 39) - 1, -j)))
    edges = [*sorted(begins), len(words)]
    places = [a for a, _ in words] + [len(text)]
    return [(places[a], places[b], low[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def plain(rows):
    """{id: (pieces removed, words removed, first holders, kept text)}: every run against every other, and every window of a passage's length."""
    parted = {i: pieces(t or "") for i, t in rows}
    seen: dict = {}
    for i, own in parted.items():
        n = [len(w) for *_, w in own]
        spans = set()
        for k in range(len(own)):
            onward = next((j for j in range(k, len(own)) if sum(n[k : j + 1]) >= s.RUN_WORDS), None)
            back = next((j for j in range(k, -1, -1) if sum(n[j : k + 1]) >= s.RUN_WORDS), None)
            spans |= ({(k, onward)} if onward is not None else set()) | ({(back, k)} if back is not None else set())
        for a, b in spans:
            seen.setdefault(tuple(w for *_, ws in own[a : b + 1] for w in ws), []).append((i, a, b))
    flat = {i: [w for *_, ws in own for w in ws] for i, own in parted.items()}
    earliest: dict = {}
    for i, words in flat.items():
        for k in range(len(words) - s.PASSAGE + 1):
            window = tuple(words[k : k + s.PASSAGE])
            earliest[window] = min(i, earliest.get(window, i))

    def sure(i, a, b):
        """Whether an earlier document holds a window that has LEAST_WORDS of the words a to b."""
        windows = [tuple(flat[i][k : k + s.PASSAGE]) for k in range(max(0, a + s.LEAST_WORDS - s.PASSAGE), min(b - s.LEAST_WORDS, len(flat[i]) - s.PASSAGE) + 1)]
        return any(earliest[w] != i for w in windows)

    later = {i: [] for i, _ in rows}
    for places in seen.values():
        first = min(p[0] for p in places)
        for i, a, b in places:
            if i != first:
                later[i].append((a, b, first))
    out = {}
    for i, t in rows:
        text, own = t or "", parted[i]
        covered = {k for a, b, _ in later[i] for k in range(a, b + 1)}
        gone, row = set(), []
        for k in range(len(own) + 1):
            if k in covered:
                row.append(k)
            else:
                a = sum(len(own[j][2]) for j in range(row[0])) if row else 0
                b = a + sum(len(own[j][2]) for j in row)
                if b - a >= s.PASSAGE or b - a >= s.LEAST_WORDS and sure(i, a, b):
                    gone |= set(row)
                row = []
        kept = text[: own[0][0] if own else len(text)] + "".join(text[a:b] for k, (a, b, _) in enumerate(own) if k not in gone)
        out[i] = (len(gone), sum(len(own[k][2]) for k in gone), sorted({f for a, _, f in later[i] if a in gone}), kept)
    return out


def shown(found):
    return {r["doc_id"]: (r["n_removed"], r["n_words_removed"], r["repeats_of"], r["text"]) for r in found}


def test_query_equals_plain(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = QUERIES["op9_span_dedup"](spark, small).collect()
    got = {r["doc_id"]: (r["n_removed"], r["n_words_removed"], r["repeats_of"], r["kept_sha256"]) for r in found}
    assert got == {i: (*v[:3], sha256(v[3])) for i, v in plain(rows).items()}


def passage(name, sentences=7, words=8):
    return " ".join(" ".join(f"{name}{k}x{j}" for j in range(words)).capitalize() + "." for k in range(sentences))


def test_repeated_passages_go_from_all_but_the_first(make_docs):
    rows = [
        (1, f"Own one here. {passage('a')} And own end."), (2, f"{passage('b')}\n{passage('a')}"), (3, f"Alone. {passage('c')}"), (-4, passage("b") + " Fin it is."),
        (5, f"{passage('d')} {passage('d')}"), (6, "Of. The. A. It is. Of. The. A."), (7, f"  \n {passage('e')}{STOP}\n{passage('f')}"), (8, f"日本{STOP}{passage('f')}"),
    ]
    found = {r["doc_id"]: r for r in s.span_dedup(make_docs(rows)).collect()}
    assert shown(found.values()) == plain(rows)
    assert found[2]["text"] == "" and found[2]["repeats_of"] == [-4, 1]
    assert found[1]["n_removed"] == found[3]["n_removed"] == found[6]["n_removed"] == 0
    # what repeats in one row only stays
    assert found[5]["n_removed"] == 0 and found[5]["text"] == rows[4][1]
    assert found[8]["text"] == f"日本{STOP}" and found[8]["repeats_of"] == [7]


def shared_removed(before, passage_words, after, kept):
    """Words of the passage that are gone; what is kept must be the host and the passage's ends."""
    left = kept.split()
    assert left[: len(before)] == before and left[len(left) - len(after) :] == after
    inner = left[len(before) : len(left) - len(after)]
    k = next((k for k in range(len(inner) + 1) if inner[:k] == passage_words[:k] and inner[k:] == passage_words[len(passage_words) - len(inner) + k :]), None)
    assert k is not None
    assert k <= s.PIECE and len(inner) - k < s.PIECE + s.SENTENCE
    return len(passage_words) - len(inner)


def test_any_shared_passage_of_51_words_goes_up_to_its_ragged_ends(make_docs):
    rng = random.Random(9)
    least = s.PASSAGE
    assert least == 51

    def prose(name, n, marks):
        return [f"{name}{rng.randrange(400)}" + ("." if rng.random() < marks else "") for _ in range(n)]

    cases, rows = [], []
    for c in range(300):
        marks = rng.choice([0, 0.03, 0.1, 0.3])
        whole = prose(f"p{c}q", rng.choice([least, least + 1, 70]), marks)
        hosts = [(prose(f"a{c}{k}h", rng.randrange(0, 25), 0.05), prose(f"b{c}{k}h", rng.randrange(0, 25), 0.05)) for k in (0, 1)]
        cases.append((whole, hosts[1]))
        rows += [(2 * c + k, " ".join(hosts[k][0] + whole + hosts[k][1])) for k in (0, 1)]
    found = {r["doc_id"]: r for r in s.span_dedup(make_docs(rows)).collect()}
    for c, (whole, (before, after)) in enumerate(cases):
        assert found[2 * c]["n_removed"] == 0 and found[2 * c + 1]["repeats_of"] == [2 * c]
        assert shared_removed(before, whole, after, found[2 * c + 1]["text"]) >= least - 2 * s.PIECE - 2 == s.LEAST_WORDS


@pytest.mark.parametrize("told", [s.TOLD, 0])
def test_short_stretches_go_only_within_shared_passages(make_docs, told, monkeypatch):
    monkeypatch.setattr(s, "TOLD", told)
    rng = random.Random(5)
    rows, passages = [], {}
    for c in range(200):
        n = 26 + c % 50
        whole = [f"p{c}q{rng.randrange(400)}" for _ in range(n)]
        for k in (0, 1, 2):
            # the third holds the middle only
            inner = whole if k < 2 else whole[5:-5]
            ends = [[f"h{c}x{k}y{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] for _ in (0, 1)]
            rows.append((3 * c + k, " ".join(ends[0] + inner + ends[1])))
            passages[3 * c + k] = len(inner) if k else 0
    rows += [(1000 + i, "la " * (20 + 7 * i)) for i in range(8)]
    found = {r["doc_id"]: r for r in s.span_dedup(make_docs(rows + rows[-3:])).collect()}
    assert shown(found.values()) == plain(rows)
    assert all((found[i]["n_removed"] > 0) == (n >= s.PASSAGE) for i, n in passages.items())


@pytest.mark.parametrize("least", [10_000, 5])
def test_hot_runs_and_hot_rows(make_docs, least, monkeypatch):
    from rillmark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", least)
    rows = [(i, f"{passage('own' + str(i), 3)} {passage('hot') if i % 2 else ''}") for i in range(300)]
    found = s.span_dedup(make_docs(rows + [(400, passage("hot"))] * 60)).collect()
    assert len(found) == 360
    expected = plain([*rows, (400, passage("hot"))])
    assert shown(found) == expected and expected[400][1] > 0


def test_odd_texts_and_empty_table(make_docs, odd_texts):
    # texts shorter than a passage stay, whatever they share
    assert {r["n_removed"] for r in s.span_dedup(make_docs([r for r in odd_texts if len((r[1] or "").split()) < s.PASSAGE])).collect()} == {0}
    same = odd_texts[3][1]
    odd_texts = [(i, f"{same}\n{same} Then." if t == same else t, *more) for i, t, *more in odd_texts]
    docs = make_docs(odd_texts)
    found = s.span_dedup(docs).collect()
    assert len(found) == len(odd_texts)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["n_removed"], r["text"]))
    assert by_id[1] == by_id[2] == [(0, "")] and by_id[3] == [(0, " \t\n\r ")]
    # equal texts: the null id holds the first; rows alike in id and text share their fate
    same = odd_texts[3][1]
    assert sorted(by_id[None]) == [(0, same), (0, "only me")]
    assert by_id[4] == [by_id[5][0]] == [by_id[5][1]] == [(by_id[4][0][0], "")]
    assert next(r["repeats_of"] for r in found if r["doc_id"] == 4) == [None]
    assert s.span_dedup(docs.filter("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b.", "c", "dd", "é!", "f\n", "。", "g。h", "\t", "I"]), max_size=80).map(" ".join), max_size=4))
def test_pieces_runs_and_removal(texts):
    data = [t.encode() for t in texts]
    found = s.Pieces(data, HASHES)
    start, end = found.runs()
    digests = [d.tobytes() for d in found.digests(start, end)]
    runs = {}
    for k, t in enumerate(texts):
        own, a = pieces(t), found.first[k]
        assert (found.bounds[a : found.first[k + 1] + 1] - found.bounds[a]).tolist() == [sum(len(w) for *_, w in own[:j]) for j in range(len(own) + 1)]
        assert all(len(w) <= s.PIECE for *_, w in own)
        n = [len(w) for *_, w in own]
        expected = set()
        for i in range(len(own)):
            expected |= {(i, j) for j in [j for j in range(i, len(own)) if sum(n[i : j + 1]) >= s.RUN_WORDS][:1]}
            expected |= {(j, i) for j in [j for j in range(i, -1, -1) if sum(n[j : i + 1]) >= s.RUN_WORDS][:1]}
        mine = [(x - a, y - 1 - a, d) for x, y, d in zip(start.tolist(), end.tolist(), digests, strict=True) if a <= x < found.first[k + 1]]
        assert sorted((x, y) for x, y, _ in mine) == sorted(expected)
        for x, y, d in mine:
            words = tuple(w for *_, ws in own[x : y + 1] for w in ws)
            assert runs.setdefault(words, d) == d
    assert len(set(runs.values())) == len(runs)


def test_ids_that_are_no_integers(make_docs):
    docs = make_docs([(1, passage("a")), (2, passage("a") + " More of it."), (None, passage("a")), (12, passage("b")), (3, passage("b"))])
    found = s.span_dedup(docs.withColumn("doc_id", docs["doc_id"].cast("string"))).collect()
    got = {r["doc_id"]: (r["n_words_removed"], r["repeats_of"], r["text"]) for r in found}
    assert got == {None: (0, [], passage("a")), "1": (56, [None], ""), "2": (56, [None], "More of it."), "12": (0, [], passage("b")), "3": (56, ["12"], "")}


def test_rows_of_one_id_are_one_document(make_docs):
    rows = [(1, f"{passage('a')} One."), (1, f"Two. {passage('a')}"), (2, f"{passage('b')} {passage('a')}"), (2, passage("b") + " Three.")]
    found = sorted((r["doc_id"], r["n_words_removed"], r["text"]) for r in s.span_dedup(make_docs(rows)).collect())
    assert [f[:2] for f in found] == [(1, 0), (1, 0), (2, 0), (2, 56)]


def test_digests_depend_on_order_and_place():
    words = [b"w%d" % i for i in range(200)]
    rng = random.Random(3)
    seen = {}
    for _ in range(400):
        own = [rng.choice(words[:6]) for _ in range(s.RUN_WORDS)]
        p = s.Pieces([b" ".join(own)], HASHES)
        d = p.digests([0], [len(p.bounds) - 1]).tobytes()
        assert seen.setdefault(d, own) == own
