"""The moderation classifier on small labelled text, and its plain spelling."""

import numpy as np
import pytest

from weftgraph.llm import abuse

DOCS = "doc_id long, text string, source string, abusive string"
LABELS = "doc_id long, abusive int, reviewer string"


@pytest.mark.parametrize(
    ("text", "plain"),
    [("You iD1oT", "you idiot"), ("du​mb", "dumb"), ("c r e t i n!", "cretin!"), ("kiss my a$$", "kiss my ass"), ("іdіot", "idiot"), ("soooo", "so"), ("step 520", "step 0"), ("@dev57", "@dev0"), ("Müll", "mull")],
)
def test_plain_spelling(text, plain):
    assert abuse.plain(text) == plain


def test_sentences_join_wrapped_lines():
    long = "What a fine piece of work this is, and how well it"
    assert abuse.sentences(f"{long}\nreads. Merge it now!\n\nok\n") == ["what a fine piece of work this is, and how well it reads", "merge it now", "ok"]
    assert abuse.sentences("Refs: 12\nidiot") == ["refs", "0", "idiot"]
    assert abuse.sentences("") == [] and abuse.sentences("\x00\udc80 broken text here")
    assert all(abuse.sentences(t) for t in ("Idiot!", "i d i o t", "!!!", '""', "a"))


def test_scores_are_those_of_the_ngrams():
    rng = np.random.default_rng(1)
    model = abuse.Model(np.arange(abuse.BUCKETS), rng.normal(size=abuse.BUCKETS).astype(np.float32), 0.5)
    texts = ["idiot", "", "a", "what a day this is", "idiot", "ß" * 9]
    together, alone = model.score(texts), np.concatenate([model.score([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-4) and abs(alone[1] - 0.5) < 1e-6


def rows():
    good = ["The table {} is rebuilt every night.", "Please lock the {} in a separate change.", "This damn {} query is slow again.", "Kill the {} process and reap the zombies."]
    bad = ["You are a stupid {} idiot.", "Go to hell with your {}, nobody asked you.", "I will find you at the {} and break your legs."]
    nouns = "ledger batch record field cursor policy meter parcel roster schema".split()
    docs, truth = [], {}
    for d in range(480):
        text = [good[(d + k) % 4].format(nouns[(d * 7 + k) % 10]) for k in range(4)]
        truth[d] = d % 4 == 0
        if truth[d]:
            text.insert(d % 5, bad[d % 3].format(nouns[d % 10]))
        docs.append((d, " ".join(text), ("Issue-Thread", "readme", None)[d % 3], "clash"))
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = rows()
    d = spark.createDataFrame(docs + docs[:9] + [(900, None, "readme", ""), (901, "", "readme", ""), (902, " \n", None, ""), (None, "text", "readme", ""), (903, "word " * 40_000, "readme", ""), (904, "Idiot!", "readme", ""), (905, "?!", "readme", "")], DOCS)
    wrong = {8, 9}
    labels = spark.createDataFrame([(n, int(truth[n] != (n in wrong)), r) for n in range(240) for r in ("a", "b")] + [(2, 1, "c"), (5, None, "a")], LABELS)
    model = abuse.train(d, labels)
    got = {r["doc_id"]: r for r in abuse.score_documents(d, model).collect()}
    assert len(got) == 486
    held = [n for n in range(240, 480)]
    assert sum(got[n]["abusive"] == truth[n] for n in held) >= 0.95 * len(held)
    assert all(got[n]["score"] is None and not got[n]["abusive"] for n in (900, 901, 902))
    assert all(got[n]["score"] is not None for n in (903, 904, 905)) and got[904]["abusive"] and not got[905]["abusive"]
    rates = {r["source"]: r["n_documents"] for r in abuse.source_rates(abuse.score_documents(d, model)).collect()}
    assert set(rates) == {"issue_thread", "readme", None} and sum(rates.values()) == 486


def test_without_labels_the_seed_text_decides(spark):
    d = spark.createDataFrame([(1, "You are a worthless idiot and a moron.", "a", ""), (2, "The build is slow again today.", "a", "")], DOCS)
    model = abuse.train(d, spark.createDataFrame([], LABELS))
    got = {r["doc_id"]: r["score"] for r in abuse.score_documents(d, model).collect()}
    assert got[1] > got[2]
    assert abuse.score_documents(d.where("false"), model).count() == 0
