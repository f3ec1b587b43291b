import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import repetition as R


def brute(words, phrase=8):
    seen, covered = set(), set()
    for k in range(len(words) - phrase + 1):
        gram = tuple(words[k : k + phrase])
        if gram in seen:
            covered |= set(range(k, k + phrase))
        seen.add(gram)
    return len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=80))
def test_repeated_words_against_brute_force(words):
    assert R.repeated_words(words) == brute(words)


def test_words():
    assert R.words_of("It's a_b  Été 42 中文") == ["it", "s", "a", "b", "été", "42", "中文"]
    assert R.words_of("") == [] and R.words_of("--- __") == []


def texts(n, seed):
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randint(0, 99)) for _ in range(k))
    out = []
    for i in range(n):
        if i % 10 == 0:
            out.append((i, " ".join([prose(12)] * 8), True))
        elif i % 10 == 1:
            once = prose(10)
            out.append((i, f"{prose(40)} {once} {prose(30)} {once}", False))
        else:
            out.append((i, prose(60), False))
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, 1.0, 2) for i, t, *_ in data], "doc_id bigint, text string, posterior double, n_words int")


def test_found_equals_the_exact_share_and_posterior_is_decisive(spark):
    data = texts(400, 1)
    df = frame(spark, data)
    assert {r.doc_id for r in R.found_repetitive(df).collect()} == {i for i, _, bad in data if bad}
    for r in R.repetition(df).collect():
        assert (r.posterior > 0.9) == data[r.doc_id][2] or not data[r.doc_id][2]


def test_odd_texts_and_tables(spark):
    long = " ".join(f"w{n}" for n in range(30_000))
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "spam " * 20), (6, long + " " + long), (7, long), (5, "spam " * 20)]
    df = frame(spark, data)
    assert sorted(r.doc_id for r in R.found_repetitive(df).collect()) == [5, 6]
    shares = {r.doc_id: (r.n_words, r.phrase_share) for r in R.repetition(df).collect()}
    assert shares[1] == shares[2] == shares[3] == (0, 0.0) and shares[6] == (60_000, 0.5) and shares[5] == (20, 19 / 20)
    assert R.found_repetitive(df.limit(0)).collect() == []


def test_clean_data_does_not_turn_the_classes_round(spark):
    df = frame(spark, [d for d in texts(300, 2) if not d[2]])
    assert R.found_repetitive(df).collect() == []
    assert R.repetition(df).agg({"posterior": "avg"}).collect()[0][0] < 0.5


def test_all_repetitive(spark):
    df = frame(spark, [d for d in texts(600, 3) if d[2]])
    assert R.found_repetitive(df).count() == 60


def test_label_model_learns_which_rules_to_trust():
    rng = random.Random(0)
    patterns = {}
    for _ in range(4000):
        bad = rng.random() < 0.3
        p = (int(bad if rng.random() < 0.97 else not bad), int(bad if rng.random() < 0.95 else not bad), int(rng.random() < 0.5))
        patterns[p] = patterns.get(p, 0) + 1
    share, table, post = R.fit_label_model(patterns)
    assert abs(share - 0.3) < 0.08 and post[1, 1, 0] > 0.9 and post[0, 0, 1] < 0.1
    assert abs(post[1, 1, 0] - post[1, 1, 1]) < 0.1
