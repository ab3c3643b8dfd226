import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from notegrain.llm import containers, tokens, visual

DOCS = "doc_id bigint, text string, ids string"
HARD = ["", None, " ", "\n\n  \t x", "don't we'll I'M", "<|endoftext|> is text", "naïve café — 東京 ルフ 🎹👩‍🎤", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "١٢٣ ²³ ½", "x" * 5000, "  mixed　blank\r\n", "\x00\x1b[0m", "ÄÖÜ" * 300, "....,,,;;;!!!???", "    indented\n        code()", "antidisestablishmentarianism internationalization"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tokens.PrefixEncoder(tokens.default_vocabulary())


def test_ids_of_hard_texts(spark, reference):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD)] + [(None, "null key", "")], DOCS)
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {i: reference(t) for i, t in enumerate(HARD)} | {None: reference("null key")}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, encoder, text):
    assert list(encoder.encode(text)) == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinorst ", max_size=80))
def test_dense_merges(reference, encoder, text):
    assert list(encoder.encode(text)) == reference(text)


def checked(plan, histogram, capacity):
    total = {}
    for config, n in plan:
        assert n > 0 and 0 < sum(s * k for s, k in config.items()) <= capacity
        for s, k in config.items():
            total[s] = total.get(s, 0) + k * n
    assert total == histogram
    return sum(n for _, n in plan)


def test_configurations_reach_the_bound_where_it_can_be_reached():
    for histogram, capacity, most in (({7: 100, 3: 100}, 10, 100), ({6: 50, 4: 20, 5: 61, 3: 40}, 10, 84), ({1: 10_000_000, 999: 7}, 1000, 10_007), ({1000: 5}, 1000, 5), ({501: 9}, 1000, 9), ({}, 10, 0)):
        assert checked(containers.configurations(histogram, capacity)[0], histogram, capacity) <= most


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_configurations_hold_everything(histogram):
    plan, bound = containers.configurations(histogram, 50, rounds=20)
    assert checked(plan, histogram, 50) >= bound >= -(-sum(s * n for s, n in histogram.items()) // 50)


def test_program_beats_best_fit_where_that_is_poor():
    histogram = {650: 3000, 690: 3000, 700: 3000}
    plan, bound = containers.configurations(histogram, 2048)
    assert checked(plan, histogram, 2048) == bound == 3000 and checked(containers.best_fit(histogram, 2048), histogram, 2048) == 3500


def test_bound_holds_for_small_histograms():
    def least(items, rooms=()):
        """Fewest containers by trying everything."""
        if not items:
            return len(rooms)
        first, rest = items[0], items[1:]
        tried = {r for r in rooms if r >= first}
        ways = [least(rest, tuple(sorted((*rooms[: rooms.index(r)], *rooms[rooms.index(r) + 1 :], r - first)))) for r in tried]
        return min([*ways, least(rest, tuple(sorted((*rooms, 10 - first))))])

    for histogram in ({6: 3, 5: 2}, {4: 5, 3: 2}, {7: 2, 4: 2, 3: 2}, {6: 4, 3: 1}):
        plan, bound = containers.configurations(histogram, 10)
        fewest = least(tuple(s for s, n in histogram.items() for _ in range(n)))
        assert bound <= fewest <= checked(plan, histogram, 10) <= fewest + 1


def test_knapsack_is_optimal():
    import itertools

    import numpy as np

    sizes, most, price = np.array([5, 4, 3]), np.array([2, 3, 2]), np.array([5.1, 4.3, 2.9])
    got = containers.knapsack(sizes, most, price, 17)
    best = max(sum(p * k for p, k in zip(price, ks)) for ks in itertools.product(range(3), range(4), range(3)) if sum(s * k for s, k in zip(sizes, ks)) <= 17)
    assert sum(sizes * got) <= 17 and sum(price * got) == pytest.approx(best)


def test_fill_places_each_unit_once(spark):
    sizes = [0, None, 1, 2048, 2049, 5000, 700, 700, 700, 648, 1] + [333] * 40
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, at string")
    assert containers.fill(df, group=4).select("container_id").distinct().count() == containers.summary(df).first().n_containers
    rows = containers.fill(df, group=4).collect()
    seen, boxes = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, set()).update(range(r.first_unit, r.first_unit + r.n_units))
        boxes.setdefault(r.container_id, []).append((r["at"], r.n_units))
    assert {k: len(v) for k, v in seen.items()} == {i: n for i, n in enumerate(sizes) if n}
    assert sum(r.n_units for r in rows) == sum(filter(None, sizes)) and len([r for r in rows if sizes[r.doc_id] <= 2048]) == len([n for n in sizes if n and n <= 2048])
    for box in boxes.values():
        end = 0
        for at, n in sorted(box):
            assert at == end
            end += n
        assert end <= 2048
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert containers.fill(none).count() == 0 and tuple(containers.summary(none).first()) == (0, 0, 0, None)


def brute(text):
    return None if text is None else unicodedata.normalize("NFC", "".join(map(visual.form, text)))


TEXTS = [
    "plain", "", None, "  ", "Ｆｕｌｌ　ｗ", "é é ẹ́ ẹ́ ẹ́ ẹ́", "соре cope", "ﬁne ﬃ Ⅸ ½ x² x2", "a​b⁠c﻿­d",
    "no break x", "co‑op co‐op co—op", "한글 한 하 각", "が が ﾊﾟ", "́start", "q̣̇ ё й Й", "\U0001d41b\U0001d428 \U0001f3b9\U0001f469‍\U0001f3a4 \U0001d15e",
    "Å Å Å Ａ̊", "line two\r\nthree", "ㅤ ͏", "x" * 3000 + "ｘ" * 3000 + "́", "́" * 200, "\x00\x1bq", "क़ क़", "̈́ ʹ ΅",
]


def test_one_form_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, shown string")
    assert {r.doc_id: r.shown for r in visual.one_form(df).collect()} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_pairs_that_look_the_same(spark):
    rows = ["cope", "соре", "cope", "cope​", "Cope", "cópe", "cópe", "x2", "x²", "a b", "a b", "a  b", "a\nb", "", "​", " ", "　", None]
    got = {tuple(r) for r in visual.look_alikes(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")).collect()}
    assert got == {(0, 1), (1, 2), (0, 3), (1, 3), (2, 3), (5, 6), (9, 10)}
    assert visual.look_alikes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeoсеоéё̣́̈ｅﬁ²​ -‐ がが한한\n"), max_size=12), min_size=1, max_size=30))
def test_any_mixture(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r.doc_id: r.shown for r in visual.one_form(df).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_accent_behind_a_thousand_shapeless_characters(spark):
    far = ["caf" + "e" + "​" * n + "́" for n in (0, 1, 10, 63, 64, 65, 70, 1000, 50_000)] + ["café", "cafe"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(far)], "doc_id bigint, text string")
    assert {r.shown for r in visual.one_form(df).filter("doc_id < 10").collect()} == {"café"}
    n = len(far) - 1
    assert {tuple(r) for r in visual.look_alikes(df).collect()} == {(a, b) for a in range(n) for b in range(a + 1, n)}


def test_letters_of_two_scripts_without_a_latin_one(spark):
    rows = ["ГПФ", "ΓΠΦ", "ⲄⲠⲪ", "ГПф"]
    got = {tuple(r) for r in visual.look_alikes(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}


def test_classes_without_pairs(spark):
    rows = ["cope", "соре", "cope", "cope​", "other", None, "", "​", "x²", "x2"]
    got = {tuple(r) for r in visual.alike_classes(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")).collect()}
    assert got == {(0, 0, 0, 3), (1, 0, 1, 3), (2, 0, 0, 3), (3, 0, 3, 3)}
    assert visual.alike_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
