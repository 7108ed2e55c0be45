"""Inputs of the registered queries, derived by Spark from the given tables. Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interaction, participant, turn, seg_idx, word_idx, word, start, end, injected."""
    injected = (F.col("conv_id") + F.col("turn")) % 7 == 3
    said = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", injected.alias("injected"), F.when(injected, "yeah.").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    words = said.select("conv_id", "turn", "role", "injected", F.posexplode(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")).alias("pos", "word")).withColumn("i", F.col("pos") + 1)
    stop = F.col("word").endswith(".")
    pause = F.when(~stop, 20).when((F.col("conv_id") + F.col("turn") + F.col("i")) % 5 == 0, 1400).otherwise(350)
    words = words.withColumn("dur", (30 * F.length("word") + 40).cast("long")).withColumn("step", F.col("dur") + pause)
    in_turn = W.partitionBy("conv_id", "turn").orderBy("i")
    words = words.withColumn("seg_idx", F.coalesce(F.sum(stop.cast("int")).over(in_turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("ran", F.sum("step").over(in_turn.rowsBetween(W.unboundedPreceding, 0)))
    total = words.groupBy("conv_id", "turn").agg(F.sum("step").alias("tot"))
    gap = (F.col("conv_id") * 7 + F.col("turn") * 389) % 1500 - 200
    in_conv = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    offset = total.select("conv_id", "turn", (F.sum(F.col("tot") + gap).over(in_conv) - F.col("tot")).alias("off"))
    out = words.join(offset, ["conv_id", "turn"])
    start = F.col("off") + F.col("ran") - F.col("step")
    who = F.concat(F.lit("P"), (2 * F.col("conv_id") + F.when(F.col("role") == "user", 0).otherwise(1)).cast("string"))
    return out.select(F.col("conv_id").alias("interaction"), who.alias("participant"), "turn", "seg_idx", F.col("i").alias("word_idx"), "word", start.alias("start"), (start + F.col("dur")).alias("end"), "injected")


def voice_activity(words: DataFrame) -> DataFrame:
    """One interval for most segments; those of injected replies come late."""
    seg = words.groupBy("interaction", "participant", "turn", "seg_idx", "injected").agg(F.min("start").alias("s"), F.max("end").alias("e")).where((F.col("interaction") + F.col("turn") + F.col("seg_idx")) % 11 != 0)
    late = F.col("injected")
    return seg.select("interaction", "participant", F.when(late, F.col("e") + 300).otherwise(F.col("s") - 60).alias("start"), F.when(late, F.col("e") + 700).otherwise(F.col("e") + 80).alias("end"))


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, start, end of the events, as long as their value in minutes."""
    start = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.round(F.coalesce("value", F.lit(0.0)) * 60000).cast("long")).alias("end")).where(F.col("end") > F.col("start"))


def pitch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("segment_id"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_extendedprice")).alias("f0"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), F.lit(64).alias("sample_rate"), F.col("embedding").alias("samples"))


def recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(pieces, known)``: the vectors of a label, one after another, are a recording of 64 samples a second; every fifth is
    silent. ``pieces`` is ``(path, vec_id, offset, samples)``, ``known`` is ``(path, sample_rate, n_frames)``."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    size = F.size("embedding")
    by = W.partitionBy("label").orderBy("vec_id").rowsBetween(W.unboundedPreceding, 0)
    samples = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    path = F.concat(F.lit("/rec/"), F.coalesce(F.col("label").cast("string"), F.lit("none")), F.lit(".wav"))
    pieces = e.select(path.alias("path"), "vec_id", (F.sum(size).over(by) - size).alias("offset"), samples.alias("samples"))
    known = e.select(path.alias("path"), size.alias("n")).groupBy("path").agg(F.lit(64).alias("sample_rate"), F.sum("n").alias("n_frames"))
    return pieces, known


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    split = F.when(k % 10 < 7, "train").when(k % 10 < 8, "dev").when(k % 10 < 9, "test").otherwise("other")
    name = F.format_string("V%d_S%d_I%d_P%d", k % 3, F.col("o_custkey"), k, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.format_string("data/%s/%s.wav", split, name).alias("path"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    detail = F.when(c % 5 == 0, " ").when(c % 7 == 0, "stranger").otherwise(F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.lit("V").alias("vendor_id"), F.col("c_nationkey").alias("session_id"), c.alias("place"), F.when(c % 11 == 0, "stranger").otherwise(F.col("c_mktsegment")).alias("relationship"), detail.alias("relationship_detail"))


def feature_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two measurements of line items; one shared column differs in some rows, and each lacks some keys."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").alias("quantity"), F.min("l_shipdate").cast("string").alias("shipped"), F.min("l_extendedprice").alias("price"), F.min("l_tax").alias("tax"))
    left = one.where(F.col("part") % 10 != 0).select("l_orderkey", "l_linenumber", "part", "quantity", "price")
    right = one.where(F.col("part") % 7 != 0).select("l_orderkey", "l_linenumber", "part", (F.col("quantity") + F.when(F.col("l_orderkey") % 13 == 0, 1).otherwise(0)).alias("quantity"), "tax")
    return left, right


def candidate_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Model answers: documents are answers of four models to shared prompts; labels stand for the transcripts."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    k = F.col("doc_id")
    prompt = F.format_string("dialog_%d_%d", F.pmod(F.floor(k / 4), F.lit(97)), F.floor(k / 4))
    model = F.element_at(F.array(*map(F.lit, ("original", "model/a", "model|b", "model_c"))), (k % 4 + 1).cast("int"))
    answer = F.when(k % 17 == 0, "").otherwise(F.format_string("audio/%d.wav", k))
    base = d.select(k, model.alias("model_name"), F.lit("test").alias("split"), F.col("lang").alias("source_style"), F.concat(F.lit("questions/"), prompt, F.lit(".wav")).alias("audio_path"), answer.alias("answer_audio_path"), F.coalesce("text", F.lit("")).alias("said"), F.floor(k / 4).alias("conv"))
    outputs = base.select("model_name", "split", "source_style", "audio_path", "answer_audio_path", F.concat(F.lit("P1A: out "), F.col("said")).alias("transcript_question"), F.concat(F.lit("P2B: "), F.col("said"), F.lit(" ")).alias("transcript_answer"), F.when(k % 5 == 0, "|P7|P8").otherwise("P3|P4").alias("speakers"), F.col("conv").cast("string").alias("conversation_id"), F.lit("stop").alias("finish_reason"), F.when(k % 3 == 0, "").when(k % 3 == 1, "0.5").otherwise("-0.25").alias("answer_start_time"), F.concat_ws("/", F.lit("outputs"), "model_name", "split", "source_style", F.lit("metadata.csv")).alias("file"))
    inputs = base.where("conv % 3 <> 0").select("split", "source_style", "audio_path", F.when(F.col("conv") % 4 == 0, "").otherwise(F.concat(F.lit(" P5C: first "), F.col("conv").cast("string"), F.lit(" P6D: last"))).alias("transcript_question"), F.lit("P9|P10").alias("speakers"), F.concat(F.lit("c"), F.col("conv").cast("string")).alias("conversation_id"), F.col("doc_id").alias("place"))
    # transcripts by path and by name only; some are blank or null, and for these another folder has a file of the name
    heard = table(spark, sf_dir, "labels").join(base, "doc_id").select("model_name", "split", "source_style", k, "answer_audio_path", F.concat(F.lit("other/"), F.format_string("%d.wav", k)).alias("elsewhere"))
    words = F.when(k % 16 == 0, F.lit(None).cast("string")).when(k % 8 == 0, " ").otherwise(F.format_string("heard it's %d", k))
    asr = heard.select("model_name", "split", "source_style", F.when(k % 2 == 0, F.col("answer_audio_path")).otherwise(F.col("elsewhere")).alias("answer_audio_path"), words.alias("ASR_transcript_answer"), (k * 2).alias("place"))
    asr = asr.unionByName(heard.where(k % 8 == 0).select("model_name", "split", "source_style", F.col("elsewhere").alias("answer_audio_path"), F.format_string("elsewhere %d", k).alias("ASR_transcript_answer"), (k * 2 + 1).alias("place")))
    seconds = lambda c: (c % 25 + 1).cast("double")
    catalog = base.where(k % 19 != 0).select(F.concat(F.lit("/root/"), F.col("answer_audio_path")).alias("path"), seconds(k).alias("duration_s")).unionByName(base.where("conv % 23 <> 0").select(F.concat(F.lit("/root/"), F.col("audio_path")).alias("path"), seconds(F.col("conv")).alias("duration_s")).distinct())
    return {"outputs": outputs, "inputs": inputs, "asr": asr, "catalog": catalog}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_returnflag").alias("condition"), F.when(F.col("l_linestatus") == "O", "natural_test").otherwise("probe").alias("dataset"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("target"), F.col("l_quantity").alias("y"), (F.col("l_quantity") + F.col("l_discount") * 10).alias("mu"), (1 + F.col("l_tax")).alias("sigma"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    score = lambda shift: (1 + (F.floor(F.coalesce("value", F.lit(0.0))) + shift) % 5).cast("double")
    return table(spark, sf_dir, "events").select((e % 300).alias("clip_id"), F.col("event_type").alias("condition"), (e % 11 == 0).alias("is_foil"), score(0).alias("overall"), score(1).alias("rhythm"), score(2).alias("emphasis"), score(3).alias("speed"), score(4).alias("pauses"))
