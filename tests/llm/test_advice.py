"""Cases that a review found missing."""

import random


def test_mix_is_the_same_however_many_cells(spark):
    from palisade.llm import mixing

    r = random.Random(5)
    docs = spark.createDataFrame([(i, "w " * r.choice((0, 1, 1, 5, 90, 91, 400)), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    whole = sorted(map(str, mixing.mix(docs).collect()))
    assert all(sorted(map(str, mixing.mix(docs, cell_rows=n).collect())) == whole for n in (7, 250))


def test_secret_that_holds_a_card_is_found_and_masked_whole():
    from palisade.llm import pii

    key = "ab12cd34ef" + "a4111111111111111b" + "0123456789ab"
    text = f'x token = "{key}" end'
    base, every = pii.find_spans(text, pii.trained())
    assert [k for k, _, _ in base] == ["card"] and set(base) < set(every)
    assert ("secret", text.index(key), text.index(key) + len(key)) in every
    assert pii.masked(text, pii.trained()) == 'x token = "<secret>" end'


def _share_of_whole_groups(spark, sizes, shards):
    import collections

    from palisade.llm import sharding

    texts = [f"text {g}" for g, n in enumerate(sizes) for _ in range(n)]
    random.Random(6).shuffle(texts)
    found = sharding.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards).collect()
    counts = collections.Counter(r.shard for r in found)
    assert len(found) == len(texts) and len({(r.shard, r.slot) for r in found}) == len(texts) and max(counts.values()) - min(counts.values()) <= 1
    where = collections.defaultdict(set)
    for r in found:
        where[texts[r.doc_id]].add(r.shard)
    linked = [g for g, n in enumerate(sizes) if n > 1]
    return sum(len(where[f"text {g}"]) == 1 for g in linked) / len(linked)


def test_groups_that_fit_a_shard_stay_whole(spark):
    assert _share_of_whole_groups(spark, [300, 200] + [70] * 4 + [1] * 3220, 8) == 1


def test_groups_find_a_shard_however_many_rows_are_linked(spark):
    assert _share_of_whole_groups(spark, [2] * 2000, 8) > 0.99


def test_confusables_are_the_whole_table():
    import string

    from palisade.functions.confusables import confusables

    table = confusables()
    sources = "".join(s for _, s in table)
    assert sorted(t for t, _ in table) == sorted(" " + string.digits + string.ascii_letters) and len(table) == 63
    assert len(sources) == len(set(sources)) == 2844
    assert [t for t, _ in table][:4] == [" ", "0", "1", "2"]
    assert {"Ꮋ", "ꓬ", "ᒿ"} <= set(sources)
