import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orebed.llm.langid import Profiles, identify_languages, page_evidence, train_profiles, trigrams
from orebed.llm.sentencepiece_codec import DEFAULT_MODEL, SPACE, Codec, Vocabulary, encode_documents

WORDS = {"en": "the and of that with from this have which their".split(), "de": "der und die nicht eine werden auch sich haben über".split(), "fr": "les des une dans pour avec être cette nous était".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 40), lang, f"host{lang}.example.com") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def profiles(labelled):
    return train_profiles(labelled, per_language=30)


def run(spark, profiles, labelled, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, confidence string")
    ground = labelled.selectExpr("-doc_id - 1 as doc_id", "text", "lang as declared", "source as host", "'x' as confidence")
    return {r.doc_id: r for r in identify_languages(df.unionAll(ground), profiles, carry=["doc_id"]).collect() if r.doc_id is None or r.doc_id >= 0}


def test_held_out_accuracy(spark, profiles, labelled):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 8), None, None, "") for i, lang in enumerate(["en", "de", "fr"] * 30)]
    got = run(spark, profiles, labelled, rows)
    right = sum(got[i].lang_id == ["en", "de", "fr"][i % 3] and not got[i].rejected for i in range(90))
    assert right >= 88


def test_evidence_beside_the_text(spark, profiles, labelled):
    rows = [
        (0, "", "de", None, ""),
        (1, None, None, "hostfr.example.com", ""),
        (2, "", None, None, ""),
        (3, "ЖЖЖЖ ЩЩЩЩ ЪЪЪЪ ЫЫЫЫ ЮЮЮЮ " * 40, None, None, ""),
        (4, "the and of that with this " * 4000, "DE-at", "hostde.example.com", ""),
        (5, "the and of", "en", "hosten.example.com", ""),
        (5, "the and of", "en", "hosten.example.com", ""),
    ]
    got = run(spark, profiles, labelled, rows)
    assert got[0].lang_id == "de" and got[1].lang_id == "fr" and got[5].lang_id == "en"
    assert got[2].rejected and got[3].rejected and got[3].lang_id == "und"
    assert got[4].lang_id == "en" and not got[4].rejected


def plain_posteriors(rows, profiles, temper=0.2, host_weight=5.0, domain_weight=20.0, unknown_prior=1e-3):
    """Every term by its definition, over (text, declared, host, domain, suffix) rows."""
    names, known = profiles.languages, profiles.languages[:-1]
    ll = [profiles.score(r[0]) for r in rows]
    sure = [(r, int(np.argmax(s))) for r, (s, n) in zip(rows, ll, strict=True) if n]
    count = lambda i, at=None, value=None: sum(1 for r, b in sure if b == i and (at is None or r[at] == value))
    base = [(count(i) + 1) / sum(count(j) + 1 for j in range(len(known))) * (1 - unknown_prior) for i in range(len(known))] + [unknown_prior]
    codes = [*known, "other"]
    code = lambda d: d if d in known else "other"
    kinds = len({r[4] for r, _ in sure if r[4]}) + 1
    out = []
    for (_, declared, host, domain, suffix), (scores, _) in zip(rows, ll, strict=True):
        log = []
        for i in range(len(names)):
            x = temper * scores[i]
            total = lambda at, value: sum(count(j, at, value) for j in range(len(names)))
            if host and total(2, host):
                of_domain = (count(i, 3, domain) + domain_weight * base[i]) / (total(3, domain) + domain_weight)
                x += np.log((count(i, 2, host) + host_weight * of_domain) / (total(2, host) + host_weight))
                if suffix:
                    x += np.log((count(i, 4, suffix) + 0.5) / (count(i) + 0.5 * kinds) if i < len(known) else 1 / kinds)
            else:
                x += np.log(base[i])
            if declared:
                said = lambda c: sum(1 for r, b in sure if b == i and r[1] and code(r[1]) == c) + 0.5
                x += np.log(said(code(declared)) / sum(said(c) for c in codes) if i < len(known) else 1 / len(codes))
            log.append(x)
        odds = np.exp(np.array(log) - max(log))
        out.append((names[int(np.argmax(log))], round(float(odds.max() / odds.sum()), 6)))
    return out


def test_posterior_is_the_product_of_its_parts(spark, profiles):
    rng = random.Random(8)
    hosts = [("a.x.co.uk", "x.co.uk", "uk"), ("b.x.co.uk", "x.co.uk", "uk"), ("y.co.uk", "y.co.uk", "uk"), ("www.z.de", "z.de", "de"), ("z.de", "z.de", "de"), ("local", "local", None), (None, None, None)]
    rows = []
    for _ in range(120):
        words = rng.choice([0, 1, 2, 30])
        rows.append((text(rng, rng.choice(["en", "de", "fr"]), words) if words else rng.choice(["", "12 34", "xq zz"]), rng.choice([None, "en", "de", "pl"]), *rng.choice(hosts)))
    df = spark.createDataFrame([(i, t, d, h) for i, (t, d, h, _, _) in enumerate(rows)], "doc_id long, text string, declared string, host string")
    got = {r.doc_id: (r.lang_id, round(r.confidence, 6)) for r in identify_languages(df, profiles, carry=["doc_id"]).collect()}
    want = plain_posteriors(rows, profiles)
    for i, (lang, confidence) in enumerate(want):
        assert got[i][0] == lang and abs(got[i][1] - confidence) < 1e-5, (rows[i], got[i], want[i])


def test_every_label_is_a_language(spark):
    rows = [(i, f"word{i % 90} " * 9, f"l{i % 90:02d}", "s") for i in range(180)]
    many = train_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert len(many.languages) == 91


def test_held_out_documents(spark, sf):
    """Accuracy on rows that the profiles are not fitted on, without their label as evidence."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = train_profiles(docs.where("doc_id % 2 = 0"))
    found = identify_languages(docs.where("doc_id % 2 = 1"), profiles, declared_col=None, host_col="source", carry=["doc_id", "lang"])
    held = [r for r in found.where("lang IS NOT NULL AND text_lang IS NOT NULL").collect()]
    assert sum(r.lang == r.lang_id for r in held) / len(held) > 0.97


def test_pages_give_evidence(spark):
    pages = spark.createDataFrame([(1, "https://u@Blog.Site.example.fr:80/de/x?y=1", '<!DOCTYPE html><HTML class="x" lang="de-AT"><style>p{}</style><script>var a="</p>"</script><!-- no --><p>und der</p>'), (2, None, None)], "page_id long, url string, html string")
    a, b = page_evidence(pages).orderBy("page_id").collect()
    assert (a.host, a.declared, a.text.split()) == ("blog.site.example.fr", "de-AT", ["und", "der"]) and (b.host, b.declared, b.text) == (None, None, "")


def test_no_rows_and_no_labels(spark, labelled, profiles):
    none = labelled.where("false")
    assert identify_languages(none.withColumnRenamed("lang", "declared"), profiles, host_col="source").count() == 0
    assert train_profiles(none).languages == ["und"]
    assert len(trigrams("")) == 0 and len(trigrams("!!! 123")) == 0


@pytest.fixture(scope="module")
def codec():
    return Codec(Vocabulary.load("/opt/tokenizers/piece_bpe_32k.model"))


def small():
    pieces = ["<unk>", "a", "b", "ab", "abc", "c", "bc", SPACE, SPACE + "a", SPACE + "ab", "cab"]
    scores = [0, -2, -2, -3, -4.5, -2, -3, -1, -2.5, -4, -5]
    return Vocabulary(pieces, [float(s) for s in scores], [-1] * 256, 0, {0})


def brute(v, chunk, unknown):
    """Best total over all ways to cut the chunk."""
    ids = {p: i for i, p in enumerate(v.pieces) if i not in v.special}
    best = [(0.0, ())] + [(float("-inf"), ())] * len(chunk)
    for e in range(1, len(chunk) + 1):
        for s in range(e):
            p = chunk[s:e]
            score = v.scores[ids[p]] if p in ids else unknown if e - s == 1 else None
            if score is not None and best[s][0] + score > best[e][0] + 1e-12:
                best[e] = (best[s][0] + score, (*best[s][1], ids.get(p, 0)))
    return best[-1][0]


@settings(max_examples=200, deadline=None)
@given(st.text("abcx ", max_size=14))
def test_viterbi_finds_the_best_total(text):
    v = small()
    c = Codec(v)
    ids = c.encode(text)
    chunk = SPACE + text.replace(" ", SPACE) if text else ""
    total = sum(v.scores[i] if i else c.unknown_score for i in ids.tolist())
    assert abs(total - brute(v, chunk, c.unknown_score)) < 1e-9
    if "x" not in text:
        assert c.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_characters=SPACE, exclude_categories=["Cs"]), max_size=60))
def test_real_vocabulary_round_trip(text):
    c = test_real_vocabulary_round_trip.codec
    assert c.decode(c.encode(text)) == text


test_real_vocabulary_round_trip.codec = Codec(Vocabulary.load("/opt/tokenizers/piece_bpe_32k.model"))


def test_words_alone_give_the_whole_text_s_best(codec):
    text = "the quick  brown fox über straße\nnew line 日本 \t end"
    whole = codec.viterbi(SPACE + text.replace(" ", SPACE))
    score = lambda ids: sum(codec.unknown_score / 3 if i in codec.byte_at else codec.v.scores[i] for i in ids)
    assert abs(score(whole) - score(codec.encode(text).tolist())) < 1e-6


def test_encode_documents(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b " * 40000, 5), (3, "x", 5), (None, "x", 5), (4, "▁", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = encode_documents(df, carry=["doc_id"]).collect()
    assert len(got) == 6 and all(r.n_tokens == len(r.token_ids) for r in got)
    assert [r.round_trip for r in got] == [True] * 5 + [False] and got[0].n_tokens == got[1].n_tokens == 0
    assert encode_documents(df.where("false")).count() == 0


def test_many_hosts_take_the_salted_join(spark, profiles, labelled):
    rows = labelled.withColumnsRenamed({"lang": "declared", "source": "host"})
    few = identify_languages(rows, profiles, carry=["doc_id"]).collect()
    many = identify_languages(rows, profiles, carry=["doc_id"], most_broadcast=0).collect()
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) == 180


def test_ids_are_those_of_the_given_model(spark, sf):
    """Whole documents and random texts, against the model's own merges."""
    import random

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    draw = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz     \n\t.,ABCéßж漢字🙂0123456789_=-<>{}()▁"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 500, "ab" * 300, " " * 77, "\n\n\n  x", "<s> </s> <0x41>", "the" * 100, "▁▁ ▁", "éﬁ", ""]
    codec = Codec(Vocabulary.load(DEFAULT_MODEL))
    assert [codec.encode(t).tolist() for t in texts] == model.encode(texts)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.token_ids for r in encode_documents(docs).collect()}
    assert got == {r.doc_id: model.encode(r.text or "") for r in docs.collect()}


def test_a_long_word_takes_linear_time():
    import random
    import time

    codec, draw = Codec(Vocabulary.load(DEFAULT_MODEL)), random.Random(3)
    text = "".join(draw.choice("abcdefghij0123456789") for _ in range(300_000))
    began = time.time()
    assert codec.decode(codec.encode(text)) == text and time.time() - began < 20


def test_words_are_remembered_without_punctuation_and_beyond_a_full_memory():
    codec, calls = Codec(Vocabulary.load(DEFAULT_MODEL), most_words=20), []
    plain = codec.viterbi
    codec.viterbi = lambda c: calls.append(c) or plain(c)
    for i in range(60):
        text = f"Straße, Straße. Straße!? {chr(97 + i % 26)}{chr(97 + i // 26)}x"
        assert codec.decode(codec.encode(text)) == text and len(codec.memo) <= 40
    assert calls.count(SPACE + "Straße") == 1 and calls.count(SPACE + "Straße,") == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab.²1 \n", max_size=12))
def test_pieces_of_letters_and_punctuation_are_not_cut(text):
    pieces = ["<unk>", "a", "b", ".", "²", "1", SPACE, "\n", "ab", "b.", "²a", "1.", ".1", SPACE + "a", SPACE + ".", "ab."]
    v = Vocabulary(pieces, [0.0] + [-2.0] * 7 + [-2.5, -2.25, -3.0, -3.0, -3.5, -2.5, -2.5, -4.0], [-1] * 256, 0, {0})
    c = Codec(v)
    ids = c.encode(text)
    assert c.decode(ids) == text
    assert not text or abs(sum(v.scores[i] for i in ids.tolist()) - brute(v, SPACE + text.replace(" ", SPACE), c.unknown_score)) < 1e-9
