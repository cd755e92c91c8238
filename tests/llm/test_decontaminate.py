import random
from collections import Counter

from rollcall.llm.decontaminate import contaminations, decontaminate
from tests.llm.conftest import prose


def brute(rows, items):
    def grams(text):
        w = (text or "").lower().split()
        return [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []

    out = {}
    for i, text in rows:
        own = grams(text)
        for j, item in items:
            want = Counter(grams(item))
            n = sum(want.values())
            for b in range(max(len(own) - n, 0) + 1):
                have = Counter(own[b : b + n])
                both = sum((have & want).values())
                union = sum(have.values()) + n - both
                if both and 100 * both >= 75 * union and both / union > out.get((i, j), (0, 0))[0]:
                    out[i, j] = (both / union, b)
    return out


ITEMS = [(1, prose(1, 40)), (2, prose(2, 30)), (3, prose(2, 30)), (4, None), (5, ""), (6, "a b c a b c a b c a b c a b c"), (7, prose(7, 300))]


def items(spark):
    return spark.createDataFrame([(*r, "z") for r in ITEMS], "item_id bigint, text string, size string")


def cases():
    one, two = ITEMS[0][1].split(), ITEMS[1][1]
    rows = [(10, prose(50, 60) + " " + " ".join(one) + " " + prose(51, 60)), (11, two.upper())]
    rows += [(12 + k, " ".join(one[:20] + [f"x{k}"] * k + one[20:])) for k in range(1, 5)]  # words put in
    rows += [(20 + k, " ".join(one[: 15] + one[15 + k :]) + " tail") for k in range(1, 5)]  # words left out
    rows += [(30 + k, prose(60 + k, 20) + " " + " ".join(one[:k] + [f"y{k}"] + one[k + 1 :])) for k in (3, 20, 35)]
    rows += [(40, prose(70, 500)), (41, " ".join(one[:12])), (42, ""), (43, None), (44, "a b c a b c a b c a b c a b c x"), (45, "short")]
    rows += [(46, prose(71, 9000) + " " + ITEMS[6][1] + " " + two + " " + two)]
    return rows


def test_all_matches_of_brute_force(spark, docs):
    got = {(r.doc_id, r.item_id): (r.similarity, r.begin) for r in contaminations(docs(cases()), items(spark)).collect()}
    want = brute(cases(), ITEMS)
    assert len(want) > 10
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v[0], 9) for k, v in want.items()}


def test_passages_with_words_put_in_and_taken_out_anywhere(spark, docs):
    """Changes at both ends and in the middle, so that the best window begins where no shingle says so."""
    rng = random.Random(4)
    item = prose(5, 200).split()
    new = iter(f"n{i}" for i in range(100_000))
    put = lambda n: [next(new) for _ in range(n)]
    rows = [(0, " ".join(put(10) + item[10:100] + put(20) + item[100:190] + put(10)))]
    for i in range(1, 40):
        words = list(item)
        for _ in range(rng.randint(1, 4)):
            at, n = rng.randrange(len(words)), rng.randint(1, 12)
            words[at : at + rng.choice([0, n])] = put(rng.choice([0, n]))
        rows.append((i, " ".join(put(rng.randrange(30)) + words + put(rng.randrange(30)))))
    one = [(9, " ".join(item))]
    table = spark.createDataFrame(one, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminations(docs(rows), table).collect()}
    want = {k: round(v[0], 9) for k, v in brute(rows, one).items()}
    assert got == want and round(want[0, 9], 2) == 0.78 and 10 < len(want) < 40


def test_clean_documents_and_rows_without_an_id_stay(spark, docs):
    rows = [(None, ITEMS[0][1]), (1, ITEMS[0][1]), (1, ITEMS[0][1]), (2, "clean"), (3, None)]
    df = docs(rows)
    out = decontaminate(df, items(spark))
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([None, 2, 3], key=repr)
    assert out.columns == df.columns


def test_short_items_and_empty_tables(spark, docs):
    short = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    found = contaminations(docs([(1, "zero one two three four"), (2, "one two"), (3, "One Two Three")]), short)
    assert sorted(r.doc_id for r in found.collect()) == [1, 3]
    none = short.limit(0)
    assert contaminations(docs([(1, "a")]), none).count() == 0
    assert contaminations(docs([]), short).count() == 0
