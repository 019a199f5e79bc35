import hashlib
import re

import pytest

from conftest import documents, frame, words
from driftline.llm import repeats


def plain(rows, length=400, words=0):
    """(n_bytes, n_removed, n_spans, digest) of each row, from all strings of ``length`` bytes."""
    count = {}
    for _, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            count[raw[k:k + length]] = count.get(raw[k:k + length], 0) + 1
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        whole = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        runs = [(a, z) for a, z in runs if not words or sum(a <= s and e <= z for s, e in whole) > words]
        kept = b"".join(raw[a:z] for a, z in zip([0, *[z for _, z in runs]], [*[a for a, _ in runs], len(raw)]))
        out.append((i, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, group, length=400, words=0):
    from pyspark.sql import functions as F
    out = repeats.remove_repeats(df, length, words, group).select(
        "row.doc_id", F.octet_length(F.coalesce("row.text", F.lit(""))), "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256))
    return sorted(map(tuple, out.collect()), key=repr)


def overlaps():
    base = words(5, 400)
    rows = [(k, words(100 + k, 10) + base[37 * k:37 * k + 380 + 11 * k]) for k in range(30)]
    return rows + [(100 + k, base[50 * k:50 * k + 399 + k % 3]) for k in range(20)]


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_every_repeat_goes_whatever_the_group_size(docs, group):
    assert found(docs, group) == plain(documents())


def test_repeats_at_every_offset(spark):
    """Overlaps, tails and heads that match different partners."""
    rows = overlaps()
    df = frame(spark, rows)
    assert found(df, repeats.GROUP) == plain(rows)
    assert found(df, 3) == plain(rows)


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_two_lengths_in_one_pass(spark, docs, group):
    for rows, df in ((overlaps(), None), (documents(), docs)):
        df = frame(spark, rows) if df is None else df
        out = repeats.with_spans(df, (400, 150), group).collect()
        for k, length in enumerate((400, 150)):
            got = sorted(((r.row.doc_id, r.text, repeats.repeated_runs(r.text.encode(), r[f"spans{k}"])) for r in out), key=repr)
            want = plain(rows, length)
            assert sorted((i, len(t.encode()), sum(z - a for a, z in s), len(s)) for i, t, s in got if i is not None) == \
                sorted(w[:4] for w in want if w[0] is not None)


def test_passages_of_over_fifty_words(spark):
    """51 shared words go, 50 stay, and so do copies of a few long words."""
    fifty_one, fifty, long_words = words(61, 51), words(62, 50), " ".join("w" * 40 + str(k) for k in range(9))
    rows = [(k, f"{words(10 + k, 8)} {p} {words(20 + k, 8)}") for k, p in
            enumerate([fifty_one, fifty_one, fifty, fifty, long_words, long_words, words(63, 70)])]
    assert min(len(fifty_one.encode()), len(fifty.encode())) >= 250
    got = found(frame(spark, rows), repeats.GROUP, repeats.PASSAGE, repeats.PASSAGE_WORDS)
    assert got == plain(rows, repeats.PASSAGE, repeats.PASSAGE_WORDS)
    assert [r[3] for r in got] == [1, 1, 0, 0, 0, 0, 0]


def test_one_span_row_for_each_class(spark, monkeypatch):
    """The join with the occurrences cannot grow with the nesting of repeats."""
    rows, seen = overlaps(), []
    real = repeats.cut_lineage

    def watch(df):
        out = real(df)
        if {"g", "c", "a0"} <= set(out.columns):
            seen.append((out.count(), out.select("g", "c").distinct().count()))
        return out
    monkeypatch.setattr(repeats, "cut_lineage", watch)
    repeats.repeated_spans(frame(spark, rows)).count()
    assert seen[-1][0] == seen[-1][1] > 0


def test_whole_words():
    raw = b"one two three"
    assert [repeats.whole_words(raw, a, z) for a, z in [(0, 13), (1, 13), (4, 7), (4, 8), (5, 6), (3, 8), (0, 12)]] == [3, 2, 1, 1, 0, 1, 2]


def test_empty_table_and_clashing_columns(no_docs, clashing, docs):
    assert repeats.remove_repeats(no_docs).count() == 0
    assert found(clashing, 8) == found(docs, 8)


def test_interval_tree():
    import numpy as np
    texts = sorted([b"banana", b"anana", b"nana", b"ana", b"na", b"a"])
    prefix = repeats._common(texts, 10)
    assert prefix.tolist() == [1, 3, 0, 0, 2]
    assert sorted(repeats.intervals(prefix)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]
    assert list(repeats.intervals(np.zeros(0, int))) == []
