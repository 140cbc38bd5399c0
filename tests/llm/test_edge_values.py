"""The values, not only the rows, that nulls, empty, long and repeated texts give; and the pipeline's stages against brute force."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from test_edges import LONG, ROWS, docs, none  # noqa: F401

import corpus_pipeline
from stateweave.llm import byte_bpe, language_id, quality_rules, secret_scan
from stateweave.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_text(rows):
    """Rows by their document's text: ids repeat."""
    texts = {i: t for i, t, *_ in ROWS}
    return [(texts[r.doc_id], r) for r in rows]


def test_byte_bpe(docs):  # noqa: F811
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, r in by_text(byte_bpe.digest(docs).collect()):
        ids = coder.encode_ordinary(text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_languages(docs):  # noqa: F811
    known = {lang for i, _, lang, *_ in ROWS if lang}
    for text, r in by_text(language_id.identify(docs).collect()):
        lettered = text is not None and any(c.isalpha() for c in text)
        assert (r.lang_pred in known) if lettered else (r.lang_pred == "und")
        assert 0 <= r.score <= 1


def test_secrets(docs, spark):  # noqa: F811
    assert all((r.n_assign, r.n_access, r.n_hex) == (0, 0, 0) and r.base_sha256 == hashlib.sha256().hexdigest() for t, r in by_text(secret_scan.digest(docs).collect()) if not t or "aaaa" not in t)
    text = "x" * 70_000 + " password = hunter2hunter AKIA" + "Q7" * 10 + " " + "0f" * 14
    one = secret_scan.digest(spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")).collect()
    assert len(one) == 3 and {(r.n_assign, r.n_access, r.n_hex) for r in one} == {(1, 1, 1)}
    at = text.index("password")
    spans = [f"assign:{at}:{at + 24}", f"access:{text.index('AKIA')}:{text.index('AKIA') + 24}", f"hex:{len(text) - 28}:{len(text)}"]
    assert {r.base_sha256 for r in one} == {hashlib.sha256(",".join(spans).encode()).hexdigest()}


def test_quality(docs):  # noqa: F811
    for text, r in by_text(quality_rules.digest(docs).collect()):
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and (not r.kept or not r.base_failed)


def prose(seed, n):
    return " ".join(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[: 4 + (seed + k) % 5].translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """150 documents of one host with a common footer; near copies; a shared passage; secrets; rejected ones; nulls and empty texts."""
    rows = [(i, prose(i, 120) + "\nthis site and all of its pages are ours", "en", "host") for i in range(150)]
    near = prose(3, 120).split()
    near[60] = "changed"
    passage = prose(9999, 70)
    rows += [(200, " ".join(near) + "\nthis site and all of its pages are ours", "en", "host"), (201, prose(4, 120), "en", "other"), (202, prose(301, 60) + " " + passage + " " + prose(302, 60), "en", "other")]
    rows += [(203, prose(303, 60) + " " + passage + " " + prose(304, 60), "en", "other"), (204, prose(305, 60) + " password = hunter2hunter " + prose(306, 10), "en", None)]
    rows += [(205, "too short", "en", "other"), (206, "again and again " * 60, "en", "other"), (207, None, None, None), (208, "", "en", "other"), (None, prose(307, 80), "en", "other")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages_against_brute_force(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    first = materialize(stages["quality_rules"](spark, corpus, ""), "stage")
    got, before = texts(first), texts(corpus)
    assert set(before) - set(got) == {205, 206, 207, 208}  # by the base rules alone
    assert all("this site" not in t for t in got.values()) and all(got[i] == before[i] for i in (201, 202, 203, 204, None))
    second = materialize(stages["near_dedup"](spark, first, ""), "stage")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in got.items() if i is not None and (w := WORD.findall(t.lower()))}
    gone = {max(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert gone == {200, 201} and set(texts(second)) == set(got) - gone
    third = materialize(stages["substring_dedup"](spark, second, ""), "stage")
    left = texts(third)
    assert set(left) == set(texts(second)) and prose(9999, 70) in left[202] and prose(9999, 70) not in left[203]
    runs = Counter(r for i, t in left.items() if i is not None for r in {tuple(w[k : k + 50]) for w in [WORD.findall(t)] for k in range(len(w) - 49)})
    assert max(runs.values()) == 1  # no 50 words are in two documents
    assert all(left[i] == t for i, t in texts(second).items() if i != 203)
    fourth = materialize(stages["secret_scan"](spark, third, ""), "stage")
    safe = texts(fourth)
    assert "hunter2" not in safe[204] and {i: t for i, t in safe.items() if i != 204} == {i: t for i, t in left.items() if i != 204}
    packed = stages["packing"](spark, fourth, "").toPandas()
    per_doc = packed.groupby("doc_id", dropna=False).agg(total=("length", "sum"), tokens=("doc_tokens", "first"))
    assert (per_doc.total == per_doc.tokens).all() and len(per_doc) == len(safe)
    for _, seq in packed.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 2048
