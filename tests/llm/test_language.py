from tidemark.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_profiles_equal_a_plain_count(spark):
    from collections import Counter
    docs = spark.createDataFrame([(1, "ab ab ba", "x"), (3, "b, Ab!", "x"), (6, "éa", "x")], "doc_id long, text string, lang string")
    docs = docs.where(~L.held_out())
    codes = L.fit_profiles(docs)["x"]
    want = Counter()
    for r in docs.collect():
        for w in "".join(x if x.isalpha() else " " for x in r["text"].lower()).split():
            for n in (1, 2, 3):
                p = f"_{w}_"
                want.update(g for g in (p[i:i + n] for i in range(len(p) - n + 1)) if g != "_")

    def shown(code):
        out = ""
        while code:
            out = (chr(code & 0x1FFFFF) if code & 0x1FFFFF > 1 else "_") + out
            code >>= 21
        return out

    counts = [want[shown(c)] for c in codes.tolist()]
    assert len(codes) == len(want) and counts == sorted(counts, reverse=True)


def test_split_by_crc(spark):
    import zlib
    ids = spark.range(200).select("id").withColumnRenamed("id", "doc_id")
    for r in ids.withColumn("h", L.held_out()).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_odd_rows(documents, odd, nothing):
    profiles = L.fit_profiles(documents)
    out = {(r["doc_id"], r["lang_pred"]) for r in L.predict(odd, profiles).collect()}
    assert {(2, "und"), (3, "und"), (6, "und"), (7, "und"), (None, "und")} <= out
    assert L.predict(odd, profiles).count() == odd.count()
    kept = L.keep_known(odd, profiles)
    assert kept.columns == odd.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 4").count() == 1
    assert L.language_digest(nothing).count() == 0
    assert {r["lang_pred"] for r in L.predict(documents, {}).collect()} == {"und"}
