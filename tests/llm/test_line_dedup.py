import hashlib
import random

from corpora import awkward, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.line_dedup import common_blocks, dedup_lines, lines_of, patience


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=25), st.lists(st.integers(0, 12), max_size=25))
def test_patience_is_an_alignment(a, b):
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert all(a[i : i + n] == b[j : j + n] and n >= 2 for i, j, n in common_blocks(a, b, 2))
    assert len(patience(a, a)) == len(a)


def test_patience_follows_unique_lines():
    assert patience("axbxc", "xaxbc") == [(0, 1), (1, 2), (2, 3), (4, 4)] or set(patience("axbxc", "xaxbc")) >= {(0, 1), (2, 3), (4, 4)}


def brute(rows, block, alone=None):
    """By definition: a line goes if it lies in a run of ``block`` lines that some document with a smaller id has, if its document repeats one, or if
    it has ``alone`` words and some document with a smaller id has it."""
    strip = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in rows}
    runs = {d: {tuple(x[i : i + block]) for i in range(len(x) - block + 1)} for d, x in strip.items()}
    out = {}
    for d, text in rows:
        lines, full = lines_of(text)
        earlier = [p for p in strip if p < d]
        gone = [any(strip[p] == strip[d] for p in earlier)] * len(full)
        for i in range(len(full) - block + 1):
            if any(tuple(strip[d][i : i + block]) in runs[p] for p in earlier):
                gone[i : i + block] = [True] * block
        for i, x in enumerate(strip[d]):
            gone[i] = gone[i] or alone is not None and len(x.split()) >= alone and any(x in strip[p] for p in earlier)
        drop = {full[i] for i, g in enumerate(gone) if g}
        kept = text if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop)
        out[d] = (len(full), sum(gone), None if kept is None else hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_against_all_pairs(spark):
    for seed in (0, 1):
        rows = awkward(seed)
        rows += [(700 + i, f"head {i}\n" + "\n".join(f"block line {j}" for j in range(6)) + f"\nmiddle {i}\n\n  block line 9  \nblock line 8\nfoot {i}") for i in range(20)]
        found = dedup_lines(clashing(documents(spark, rows)).repartition(4)).collect()
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"], r["text"]) for r in found}
        assert got == brute(rows, 2)
        assert found[0]["slice_id"] == "clash" and found[0]["lang"] == "en"


def test_edges(spark):
    assert dedup_lines(documents(spark, [(1, "a")]).limit(0)).count() == 0
    rows = [(1, "a\nb\nc"), (1, "x\ny\nz"), (None, "a\nb\nc"), (2, "a\nb\nc"), (3, "x\ny\nz"), (3, "new\na\nb")]
    got = sorted(((r["doc_id"] is not None, r["doc_id"]), r["n_removed"], r["text"]) for r in dedup_lines(documents(spark, rows)).collect())
    assert ((False, None), 0, "a\nb\nc") in got and ((True, 2), 3, "") in got and ((True, 1), 0, "a\nb\nc") in got and ((True, 1), 0, "x\ny\nz") in got


def test_each_repeated_block_meets_a_holder(spark):
    """A holder of one line only, or other first holders of its lines, come before a block's holder."""
    rows = [(1, "L1"), (2, "L1\nL2"), (3, "L1"), (4, "x\nL1\nL2\ny")]
    rows += [(10, "A1\nz"), (11, "w\nA2"), (12, "A1\nA2\nv")] + [(20 + i, f"A1\nn{i}\nA2\nm{i}") for i in range(60)] + [(90, "u\nA1\nA2")]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in dedup_lines(documents(spark, rows)).collect()}
    assert got[4] == (2, "x\ny") and got[90] == (2, "u")
    assert {i for i, v in got.items() if v[0]} == {3, 4, 90}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20), st.integers(1, 3))
def test_blocks_hold_every_common_run(a, b, least):
    blocks, runs = common_blocks(a, b, least), {tuple(b[j : j + least]) for j in range(len(b) - least + 1)}
    assert all(a[i : i + n] == b[j : j + n] and n >= least for i, j, n in blocks)
    common = {x for i in range(len(a) - least + 1) if tuple(a[i : i + least]) in runs for x in range(i, i + least)}
    assert common == {x for i, _, n in blocks for x in range(i, i + n)}


def every_pair(rows, block):
    """Lines removed of each document if it is aligned with all earlier ones."""
    strip = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in rows}
    out = {}
    for d in strip:
        gone = set()
        for p in strip:
            if p < d and strip[p] == strip[d]:
                gone |= set(range(len(strip[d])))
            elif p < d:
                gone |= {x for i, _, n in common_blocks(strip[d], strip[p], block) for x in range(i, i + n)}
        out[d] = len(gone)
    return out


def test_against_alignment_of_all_pairs(spark):
    rows = [(1001, "X\nL1\nL2\nW"), (1002, "Y\nL1\nL2\nZ\nL1\nL2\nV"), (1003, "p\nq\nr\ns"), (1004, "r\ns\np\nq"), (1005, "new\nr\ns\np\nq")]
    rng = random.Random(3)
    rows += [(1100 + i, "\n".join(f"line {rng.randrange(30)}" for _ in range(rng.randint(1, 12)))) for i in range(150)]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in dedup_lines(documents(spark, rows + awkward(5))).collect()}
    assert got[1002] == (4, "Y\nZ\nV") and got[1004] == (4, "") and got[1005] == (4, "new")
    assert {d: v[0] for d, v in got.items()} == every_pair(rows + awkward(5), 2)


def test_long_lines_are_blocks_alone(spark):
    passage, short = " ".join(f"word{i}" for i in range(50)), " ".join(f"word{i}" for i in range(49))
    rows = [(1, f"a\n{passage}\nb\n{short}"), (2, f"c\n {passage} \nd\n{short}\n{passage}"), (3, f"{passage}\ne")]
    removed = lambda **x: {r["doc_id"]: (r["n_removed"], r["text"]) for r in dedup_lines(documents(spark, rows), **x).collect()}
    got = removed(alone=50)
    assert got[1][0] == 0 and got[2] == (2, f"c\nd\n{short}") and got[3] == (1, "e")
    assert not any(v[0] for v in removed().values())
