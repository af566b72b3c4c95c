from edges import ROWS, docs, empty

from paperloom.llm import toxicity as T
from paperloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def reader():
    return T.Reader(T.Model(words={"idiot": 4.0}, prefixes={"vequ": 3.0}, bias=-4.0, worst=1.0, total=1.0))


def test_clauses_not_words_are_scored():
    weigh = lambda text: reader().clauses(text)[1]
    plain = weigh("what an idiot.")
    assert weigh("You are an idiot.") > plain > weigh("That is not an idiot.") > 0
    assert weigh("She said: an idiot.") == plain  # a colon ends the clause
    assert plain > weigh("the man said idiot")
    assert weigh("not at all, by any means whatever, an idiot") == plain  # beyond the reach of the negation
    assert weigh("not good. an idiot") == plain
    assert weigh("I will kill you") < weigh("you, I will kill you")
    assert weigh("VEQUANT") == weigh("vequxyz!!") == 3.0 and weigh("idiotic vequ1") == 3.0
    assert reader().clauses("nothing here") == (0.0, 0.0)


def test_composition_equals_running_one_after_the_other():
    steps = [(T.negation(), "0"), (T.reported(), "plain"), (T.directed(), "none")]
    whole = T.grammar()
    for sentence in ("NWIRTIH", "TNIRIWWI", "RNHTI", "WWNNWIIII"):
        states, at = [s for _, s in steps], T.START
        for symbol in sentence:
            at, weight = whole[at, symbol]
            for i, (rules, _) in enumerate(steps):
                states[i], symbol = rules[states[i], symbol]
            assert (at, weight) == ("/".join(states), T.WEIGHTS.get(symbol, 0.0))


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null")
    rows = QUERIES["op6_toxicity"](spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.toxic == r.predicted for r in rows) > 0.93 * len(rows)
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)


def test_edge_rows(spark):
    source = docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    model = T.learn(source, labels)
    rows = T.score(source, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    none = T.learn(source, labels.where("toxic = 9"))
    assert not none.words and {r.predicted for r in T.score(source, none).collect()} == {0}
    assert T.score(empty(spark), model).count() == 0
    assert not T.learn(empty(spark), labels).words


def test_learns_words_and_starts_of_words(spark):
    rows = [(i, f"alles gut hier {i}", "", "") for i in range(200)]
    rows += [(1000 + i, f"du {'grobian' if i % 2 else f'schurk{chr(97 + i % 26)}{chr(97 + i % 7)}'} sagt {i}", "", "") for i in range(120)]
    labels = spark.createDataFrame([(r[0], int(r[0] >= 1000)) for r in rows], "doc_id long, toxic int")
    model = T.learn(docs(spark, rows), labels)
    assert any("grobian".startswith(w) for w in [*model.words, *model.prefixes])
    assert any("schurk".startswith(p) for p in model.prefixes)
    got = {r.doc_id: r.predicted for r in T.score(docs(spark, rows), model).collect()}
    assert sum(got[r[0]] == (r[0] >= 1000) for r in rows) == len(rows)
