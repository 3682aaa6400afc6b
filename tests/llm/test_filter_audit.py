"""Every order applied left to right, document by document, against the walk over sets."""

import re
from itertools import permutations

import numpy as np
import pytest

from askgrid.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(doc_id, text, rows):
    words = WORD.findall(text)
    smallest = min((i for i, t, _ in rows if (t or "") == text and i is not None), default=None)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum(c in filter_audit.CAPITALS for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and doc_id > smallest}


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = [(s or "", i, failures(i, t or "", rows)) for i, t, s in rows]
    out = {}
    for part in {p for p, _, _ in judged}:
        mine = [(i, f) for p, i, f in judged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[name] for _, f in mine) - len(gone),
                    sum(f[name] and sum(f.values()) == 1 for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for part_, order, step in out:
            if part_ == part:
                out[part, order, step].append(shapley[order[step - 1]])
    return out


def rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(90)] + ["Big", "LOUD", "#tag", "50%"]
    out = [(i, " ".join(rng.choice(words, int(rng.integers(30, 120)))), ["a", "b", "", None][i % 4]) for i in range(60)]
    out += [(i, out[i % 7][1], "a") for i in range(100, 160)]  # a large group of copies
    out += [(200, None, "a"), (201, "", "b"), (202, " \t\n", None), (None, out[0][1], "a"), (None, None, None), (None, "only here", "c")]
    out += [(5, out[5][1], "b"), (5, out[5][1], "b"), (5, "another text of id five", "b"), (-1, out[3][1], "d")]
    out += [(300, "very " * 200_000 + "long", "a"), (301, " ".join(f"é{i}" for i in range(50_000)), "b")]
    return out


LABELS = [(i, i % 2, i % 3 == 0) for i in range(0, 170, 2)] + [(1, None, 1), (None, 1, 1), (3, 0, 0), (3, 1, None)]


def test_filter_audit_equals_every_order(spark):
    docs = spark.createDataFrame([(*r, "m", 9, "p") for r in rows()], "doc_id long, text string, source string, mask string, n int, part string").repartition(4)
    labels = spark.createDataFrame([(i, q, None if t is None else int(t), "x") for i, q, t in LABELS], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.filter_audit(docs, labels).collect()
    want = brute(rows(), LABELS)
    assert len(got) == len(want) == 120 * 5 * 5
    for r in got:
        assert [r[c] for c in filter_audit.COUNTS] == want[r.part, r.filter_order, r.step], (r.part, r.filter_order, r.step)


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    got = filter_audit.filter_audit(docs, labels).collect()
    assert len(got) == 600 and all(r.good_lost == 0 and r.kept == (0 if "A" in r.filter_order[:r.step] else 1) for r in got)


@pytest.mark.parametrize("filters", [1, 3, 6])
def test_gray_walk_counts_what_no_filter_hits(filters):
    counts = np.random.default_rng(filters).integers(0, 50, (2, 1 << filters))
    walked = filter_audit.gray_walk(counts, filters)
    for on in range(1 << filters):
        clear = [m for m in range(1 << filters) if m & on == 0]
        assert (walked[:, on] == counts[:, clear].sum(axis=1)).all()
