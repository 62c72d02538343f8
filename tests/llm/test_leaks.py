import random

import pytest

pytest.importorskip("pelorus.llm")
from pelorus.llm import leaks as L  # noqa: E402

WORDS = [f"{a}{b}{c}" for a in ("bra", "cor", "del", "fen", "gal") for b in ("mi", "no", "pu", "ra") for c in ("st", "nd", "lk", "rm", "sh")]


def passage(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    t = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    return sorted((r.doc_id, r.item_id) for r in L.leaks(d, t, **kw).select("doc_id", "item_id").collect())


def test_whole_and_partial_passages_with_slips_and_notes(spark):
    item = passage(1, 80)
    other = passage(2, 200)
    slipped = list(item[10:50])
    for k in (4, 13, 21, 33):
        w = slipped[k]
        slipped[k] = w[:2] + w[3:] if k % 2 else w[:2] + w[3] + w[2] + w[4:]
    broken = [w if k % 9 else w[:3] + "-\n" + w[3:] for k, w in enumerate(item[:40])]
    docs = [
        (1, " ".join(other[:50] + item + other[50:])),
        (2, " ".join(other[:9] + item[20:50] + other[9:90])),  # thirty words exactly
        (3, " ".join(other[:9] + item[20:49] + other[9:90])),  # twenty-nine
        (4, " ".join(other[:30] + slipped + other[30:])),
        (5, " ".join(other[:30]).upper() + " — " + " ".join(item[:20]).upper() + " [An hon. Member: Shame!] " + ",\n> ".join(item[20:45])),
        (6, " ".join(other[:30] + broken + other[30:])),
        (7, " ".join(other)), (8, None), (9, ""), (10, " ".join(item[:15] + other[:30] + item[15:35])),
    ]
    assert found(spark, docs, [(1, " ".join(item)), (2, None), (3, ""), (4, "...")]) == [(d, 1) for d in (1, 2, 4, 5, 6)]


def test_accents_short_items_repeats_and_blocks(spark):
    short = "Vive la république des îles, vive le port!"
    item = " ".join(passage(3, 60))
    docs = [(1, "On a dit: VIVE LA REPUBLIQUE DES ILES vive le port hier."), (2, "vive la république"), (3, item), (3, item), (4, item + " " + item)]
    got = found(spark, docs, [(1, short), (2, item), (3, item)], block_words=50)
    assert got == sorted([(1, 1), (3, 2), (3, 2), (3, 3), (3, 3), (4, 2), (4, 3)])


def test_another_number_is_another_statement(spark):
    a = passage(4, 40)
    a[20] = "1537"
    b = list(a)
    b[20] = "1547"
    assert found(spark, [(1, " ".join(b))], [(1, " ".join(a))]) == []


def test_a_very_long_document_and_empty_tables(spark):
    item = passage(5, 50)
    long = passage(6, 60_000)
    assert found(spark, [(1, " ".join(long + item))], [(7, " ".join(item))]) == [(1, 7)]
    assert found(spark, [], [(7, " ".join(item))]) == []
    assert found(spark, [(1, "a b c")], []) == []


def test_slips():
    assert L.slip("register", "regitser") and L.slip("reached", "rached") and L.slip("pensioners", "penisonres")
    assert not L.slip("reached", "bench") and not L.slip("537", "547") and not L.slip("a", "b")


def test_notes_of_any_length_and_depth_and_brackets_without_partner(spark):
    item, other = passage(7, 40), " ".join(passage(8, 30))
    half = " ".join(item[:20]), " ".join(item[20:])
    notes = ("[" + "x y z " * 50 + "]", "[An hon. Member (Mr. Foo [sic]): Shame!]", "(" + "hear " * 3000 + "(so it was [noted])" + ")", "a) ")
    docs = [(k, f"{other} {half[0]} {note} {half[1]} {other}") for k, note in enumerate(notes[:3])]
    docs += [(3, f"( {other} {half[0]} {half[1]} a) {other}"), (4, f"({' '.join(item)})"), (5, f"[ {other} {' '.join(item)} ] {other}")]
    assert found(spark, docs, [(1, " ".join(item))]) == [(k, 1) for k in range(6)]
    assert L.without_notes("a (b) c) d [e (f] g").split() == ["a", "c)", "d", "g"]


@pytest.mark.parametrize("slips", [0, 5, 8, 12, 20])
def test_recall_however_many_words_have_slips(slips):
    r = random.Random(slips)
    index = L.Index([(k, " ".join(passage(100 + k, 120))) for k in range(20)], 30)
    texts, want = [], []
    for _ in range(200):
        k = r.randrange(20)
        at = r.randrange(90)
        ws = index.words[k][at : at + 30]
        for i in r.sample(range(30), slips):
            w, j = ws[i], r.randrange(len(ws[i]) - 1)
            ws[i] = (w[:j] + w[j + 1 :], w[:j] + w[j + 1] + w[j] + w[j + 2 :], w[:j] + "z" + w[j + 1 :], w[:j] + "w" + w[j:])[r.randrange(4)]
        texts.append(passage(r.random(), 20) + ws + passage(r.random(), 20))
        want.append(k)
    got = index.search(texts, L._Seen(index.vocabulary))
    assert sum((d, k) in got for d, k in enumerate(want)) >= 0.9 * len(want)


def test_items_of_few_words_with_a_slip(spark):
    items = [(1, "governor"), (2, "quarry tender"), (3, "the harbour pilots refused"), (4, "we shall mend every lantern along this quay before winter comes"), (5, "of it")]
    docs = [(1, "the governr spoke"), (2, "a quarry tendr here"), (3, "so the harbuor pilots refused it"), (4, "We shall mend evry lantern along thsi quay before wintr comes."), (5, "of it"), (6, "it of")]
    assert found(spark, docs, items) == [(d, d) for d in range(1, 6)]
