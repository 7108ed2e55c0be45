import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from dyadspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_round_trip(spark, library):
    rnd = random.Random(4)
    signs = "abc dest'  \n\t éß日本١२½!?.,'’  \u0085 　 reellvemsdt012_-😀‍\x1c"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "\n\n x", "'s", "''s", "'street", "x'll've'd", "a" * 5000, " " * 300 + "x", "word " * 20000]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>'s"]
    rows = list(enumerate(texts)) + [(None, None), (7, "again"), (7, "again")]
    frame = spark.createDataFrame(rows, DOC).repartition(2)
    out = bpe.encode(frame, PATH)
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
        assert r.n_tokens == len(r.ids)
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids in [r.ids for r in by_id[i]]
    assert by_id[None][0].ids == []
    back = {r.doc_id: r.text for r in bpe.decode(out.where("doc_id > 7"), PATH).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if i > 7)


def test_every_token_encodes_to_itself(library):
    """The prefix tables rest on it: each token of the vocabulary that stands alone is one id."""
    import numpy as np

    codec = bpe.Codec(PATH)
    width = np.diff(codec.name_at)
    usable = np.array([i for i in range(codec.size) if width[i] and i not in codec.special.values()])
    ids, counts = codec.encode_pieces(codec.names, codec.name_at[usable], width[usable])
    assert (counts == 1).all() and (ids == usable).all()


def test_empty_and_other_columns(spark):
    assert bpe.encode(spark.createDataFrame([], DOC), PATH).count() == 0
    odd = spark.createDataFrame([(1, "a b", [9])], "doc_id int, text string, ids array<int>")
    assert bpe.encode(odd, PATH).columns == ["doc_id", "n_tokens", "ids"]
