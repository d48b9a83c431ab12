"""Random access to the sequences of a token file against reading it from the start."""

import numpy as np
import pyarrow as pa
import pytest
from test_operators import public_vocabulary

from tabspark.llm.token_files import Sequences, ids_of, write_token_files


def test_any_sequence_by_number_without_copies(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the word {i} " * (i % 37)) for i in range(400)], "doc_id long, text string").coalesce(1)
    files = write_token_files(docs, public_vocabulary("word_bpe_49k.json"), length=64, rows_per_batch=3, folder=str(tmp_path))
    for name, n_ids in [(r["name"], r["n_ids"]) for r in files.files.collect()]:
        path = f"{tmp_path}/{name}.ids.arrow"
        with pa.ipc.open_stream(path) as stream:
            every = np.concatenate(list(ids_of(stream)))
        held = pa.total_allocated_bytes()
        found = Sequences(path)
        assert len(found) == -(-n_ids // 64) and len(every) == n_ids
        for number in np.random.default_rng(2).permutation(len(found)).tolist():
            ids, mask = found[number]
            assert len(ids) == len(mask) == 64 and not ids.flags.writeable and not ids.flags.owndata
            assert (ids[mask] == every[number * 64 : (number + 1) * 64]).all()
            assert mask.all() or number == len(found) - 1
        assert pa.total_allocated_bytes() - held < 4096
        assert (found[-1][0] == found[len(found) - 1][0]).all()
        for wrong in (len(found), -len(found) - 1):
            with pytest.raises(IndexError):
                found[wrong]


def test_parts_are_encoded_once_whatever_words_they_stand_in():
    """Ids by parts equal those of the whole tokenizer, and the model sees a run of letters once."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tabspark.llm.queries import public_vocabulary
    from tabspark.llm.text import pieces
    from tabspark.llm.token_files import WordEncoder, json_words

    path = public_vocabulary("word_bpe_49k.json")
    texts = ["Word word. (word) WORD!! word12x word%%%", "", None, "it's <s> </s> o\u0301 \u00d6l a\u00a0b \x01 don't-stop", "word\t\nword", "\x85 \u2003x"]
    encode, size, direct = json_words(path)
    assert direct
    seen = []
    for cut in (True, False):
        encoder = WordEncoder(lambda parts, whole: seen.extend(parts) or encode(parts, whole), size, cut)
        tokenizer = Tokenizer.from_file(path)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        for most in (1, 1 << 20):
            got = []
            for piece in pieces(pa.array(texts), most):
                ids, ends = encoder.encode(piece, 1)
                got += [x.tolist() for x in np.split(ids, ends[:-1])]
            assert got == want
        if cut:
            assert seen.count(b"word") == 1
    words_end = encoder.encode(next(pieces(pa.array(["one two", "three"]))), 1, with_words=True)[2].tolist()
    assert len(words_end) == 5 and words_end == sorted(words_end)
