from rosterflow.llm import simhash


def test_the_closest_copies_are_met_by_fingerprint(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(f"v{i}" for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = []
    kept = simhash.met_by_fingerprint

    def noted(prints):
        out = kept(prints)
        asked.extend(map(tuple, out.collect()))
        return out

    monkeypatch.setattr(simhash, "met_by_fingerprint", noted)
    assert sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == [0, 2]
    assert len(asked) == 1
