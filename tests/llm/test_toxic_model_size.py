"""What the driver passes on of the toxicity model: taken slots and learned embeddings, nothing else."""

import pickle

import numpy as np
import pyarrow as pa

from dyadspark.llm import toxicity


def test_a_model_travels_without_its_empty_slots():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(12)) + (" vile" if i % 2 else "") for i in range(600)]
    labels = np.arange(600) % 2
    model = toxicity.train(texts, labels, ["aa"] * 600)
    sent = pickle.dumps(model)
    assert len(sent) < model.embedding.nbytes + 16 * len(model.embedding) + (1 << 16) < 1 << 21  # the tables alone are 8 MB
    got = pickle.loads(sent)
    assert all(np.array_equal(getattr(model, k), getattr(got, k)) for k in ("fingerprint", "row", "embedding"))
    assert got.thresholds == model.thresholds and got.shift == model.shift
    given = toxicity.word_hashes(*toxicity.as_bytes(pa.array([*texts[:50], "", "?"])))
    assert np.array_equal(model.score(*given), got.score(*given))
    none = pickle.loads(pickle.dumps(toxicity.train([], np.zeros(0), [])))
    assert none.score(*given).tolist() == [0.0] * 52
