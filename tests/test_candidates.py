from dyadspark.operators import candidates


def test_texts_meet_the_lookups_in_one_join_and_no_row_is_lost(spark):
    own = "model_name string, split string, source_style string, audio_path string, answer_audio_path string, transcript_question string, transcript_answer string, speakers string, conversation_id string, answer_start_time string"
    rows = [("m", "test", None, "q/d_1.wav", None, "a", "one", "P1|P2", "1", ""), ("m", "test", "calm", "q/d_1.wav", "a/1.wav", "b", "two", "P1|P2", "1", "0.5"), ("m", "test", "calm", "q/d_1.wav", "a/1.wav", "c", "three", "P1|P2", "1", ""), (None, "test", "calm", None, "a/1.wav", "d", "four", None, None, None)]
    outputs = spark.createDataFrame(rows, own)
    inputs = spark.createDataFrame([("test", "calm", "q/d_1.wav", "asked", "P9|P8", "c1", 1)], "split string, source_style string, audio_path string, transcript_question string, speakers string, conversation_id string, place int")
    asr = spark.createDataFrame([("m", "test", "calm", "a/1.wav", "heard", 1)], "model_name string, split string, source_style string, answer_audio_path string, ASR_transcript_answer string, place int")
    catalog = spark.createDataFrame([("/r/q/d_1.wav", 4.0), ("/r/a/1.wav", 5.0)], "path string, duration_s double")
    found = candidates.manifest(outputs, inputs, asr, catalog, "/r", order=["place"])
    got = sorted((r.response_metadata_transcript, r.status, r.prompt_transcript, r.response_transcript) for r in found.collect())
    assert got == [("four", "MISSING_PROMPT_AUDIO_FILE", "d", "four"), ("one", "MISSING_RESPONSE_AUDIO_PATH", "a", "one"), ("three", "OK", "asked", "heard"), ("two", "OK", "asked", "heard")]

    def joins(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        carries = any("transcript_answer#" in str(b.output()) and "ASR" not in str(b.output()) for b in below)
        return (node.nodeName() == "Join" and carries) + sum(map(joins, below))

    assert joins(candidates.usable(found)._jdf.queryExecution().optimizedPlan()) == 1
