"""The text operators against plain versions on small tables with nulls, empty and long texts, copies, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerloom.llm import components, decontamination, fingerprints, language, licenses, likelihood, near_dup, pieces, secrets, token_counts, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(draw, n):
    return " ".join("".join(draw.choices("abcdeéß", k=draw.randint(1, 6))) for _ in range(n))


def corpus():
    """(doc_id, text) rows with near and exact copies and every odd case."""
    draw = random.Random(4)
    rows = []
    for i in range(60):
        rows.append((i, sentence(draw, draw.randint(3, 60)).capitalize()))
    base = sentence(draw, 120).split()
    for i in range(60, 110):  # a chain of near copies, some beyond the threshold
        changed = list(base)
        for _ in range(draw.randint(0, 5)):
            changed[draw.randrange(len(changed))] = "x" + str(draw.randint(0, 9))
        rows.append((i, " ".join(changed)))
    shared = sentence(draw, 30)
    rows += [(i, sentence(draw, 12) + "\n" + shared) for i in range(110, 150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, ""), (203, " \t\n"), (204, None), (205, "one two"), (206, "One  TWO"), (207, sentence(draw, 30_000)), (208, "\x00\x1fÄ Ä É"), (209, " two  blanks "), (210, "  "), (211, "a▁b 世界\r\n🙂🙂"), (None, rows[5][1]), (None, None)]
    rows += [rows[7], rows[7]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus with columns whose names the operators use themselves."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit(f"{c} of the caller").alias(c) for c in ("h", "n", "node", "part", "window", "score", "key", "sig", "piece", "label", "base"))).repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df, *columns):
    found = {}
    for r in df.select("doc_id", *columns).collect():
        found.setdefault(r[0], []).append(tuple(r)[1:])
    return found


def shingles(text, width):
    words = (text or "").translate(UPPER).encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("limits", [{}, {"SMALL": 3, "BLOCK": 7, "LEADERS": 2, "DEPTH": 2}])
def test_near_duplicates_are_the_components_of_all_links(spark, docs, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dup, name, value)
    rows = corpus()
    want = plain_components(rows, 4, 80)
    found = near_dup.near_duplicates(docs, width=4).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = Counter((r.doc_id, r.n_shingles) for r in found)
    assert sizes == Counter((i, len(shingles(t, 4))) for i, t in rows)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(empty(spark)).collect() == []
    lone = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(lone).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_rows_of_one_id_are_one_document(spark):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abc"]
    rows = spark.createDataFrame([(1, texts[0]), (9, texts[0]), (9, texts[1]), (4, texts[1]), (5, texts[2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(rows).collect()} == {1: 1, 9: 1, 4: 1, 5: 5}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_token_counts_equal_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = by_id(token_counts.token_counts(docs, limit=20), "n_bytes", "n_tokens", "over_limit")
    rows = corpus()
    assert sum(map(len, found.values())) == len(rows)
    for i, t in rows:
        n = len(sp.encode(t or ""))
        assert (len((t or "").encode()), n, n > 20) in found[i], (i, t)
    assert token_counts.token_counts(empty(spark)).collect() == []


def test_pre_tokens_add_up():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    lengths = token_counts.Lengths({}, MODEL)
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choices(["a", "the", " ", "  ", "▁", "\n", "世", "é", "<s>", ".", "🙂", "\t"], k=draw.randint(0, 12)))
        assert sum(lengths[x] for x in token_counts.pre_tokens(text)) == len(sp.encode(text)), repr(text)


def test_pieces_are_the_best_segmentation(tmp_path):
    """Against the library with the same pieces as a unigram model. Blank pieces, scored -1e9 in the file, get a score that its float32 sums can hold."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if set(p.piece) == {"▁"}:
            p.score = -40_000
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Pieces(str(path))
    draw = random.Random(1)
    same = 0
    for _ in range(4000):
        word = "".join(draw.choices("etaoinshrdlucmfüéñß.,E世", k=draw.randint(1, 14)))
        got, want = own.encode(word), library.encode(word)
        cost = lambda ids: sum(library.get_score(i) for i in ids)
        same += got == want
        if not {own.bytes.get(i) for i in got + want} - {None}:
            assert cost(got) == cost(want), word
    assert same > 3900


def test_round_trip_restores_every_text(spark, docs):
    found = pieces.round_trip(docs).collect()
    assert len(found) == len(corpus()) and all(r.restored for r in found)
    encoded = pieces.encode(docs.withColumn("piece_ids", F.lit(1)))
    assert sorted(encoded.columns) == sorted([*docs.columns, "piece_ids"])
    assert {tuple(r.piece_ids) for r in encoded.filter("text is null or text = ''").collect()} == {()}
    gone = encoded.withColumn("piece_ids", F.lit(None).cast("array<int>"))
    assert {r.decoded for r in pieces.decode(gone).collect()} == {None}
    assert pieces.round_trip(empty(spark)).collect() == []


def test_columns_of_pieces_decode_as_lists_do():
    """Nulls, empty lists, byte pieces that spell a character, a blank mark or nothing valid, and slices of a column."""
    own = pieces.load(MODEL)
    rows = [[], None, own.encode("a b\n世🙂 c"), own.encode(" x"), [own.byte_ids[b] for b in "▁é".encode()], [own.byte_ids[0xE2], own.byte_ids[65]], own.encode("the end")]
    wrong = rows[:5] + rows[6:]
    for lists in (rows, wrong, [None], [], [[]]):
        column = pa.array(lists, pa.list_(pa.int32()))
        for part in (column, column.slice(1), column.slice(1, 3)):
            assert own.decoded(part).to_pylist() == [None if x is None else own.decode(x) for x in part.to_pylist()]
    assert own.decoded(pa.array(wrong, pa.list_(pa.int32()))).to_pylist()[2:5] == ["a b\n世🙂 c", " x", "é"]


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def licence_rows():
    draw = random.Random(9)
    told = licenses.TEMPLATES["bsd"][0]
    cut = told.split()
    return [*corpus(), (300, "See the MIT License, mit LICENSE mit-license."), (301, sentence(draw, 20) + " " + told.upper()), (302, "GNU General\nPublic License; Apache-License"),
            (303, "mit license mit license"), (304, " ".join(cut[:6] + ["other"] + cut[6:])), (305, "redistribution and use"), (306, "following conditions binary forms " + sentence(draw, 9)),
            (307, "İ MIT License K"), (308, licenses.TEMPLATES["mpl"][0]), (308, licenses.TEMPLATES["isc"][0])]


def test_licenses(spark):
    rows = licence_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("mit")).withColumn("h", F.lit(1))
    found = by_id(licenses.scan(df), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sum(map(len, found.values())) == len(rows)
    for i, t in rows:
        w = words_of(t)
        hits = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want = (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), sorted({x for _, x in hits}))
        assert want in [x[:5] for x in found[i]], (i, t, found[i])
    told = {i: x[0][5] for i, x in found.items()}
    assert told[301] == ["bsd"] and told[304] == ["bsd"] and told[305] == [] and told[306] == []
    assert sorted(x[5] for x in found[308]) == [["isc"], ["mpl"]]
    assert all(set(x[4]) <= set(x[5]) and 0 <= x[6] <= 1 and (x[6] > 0) == bool(x[5]) for v in found.values() for x in v)
    assert licenses.scan(empty(spark)).collect() == []


def test_every_license_of_one_file(spark):
    """All templates with prose between them that holds licence words of its own."""
    draw = random.Random(12)
    prose = lambda: " ".join(draw.choices([*licenses.vocabulary(), "lorem", "ipsum", "dolor"], k=400))
    notices = " ".join(f"{prose()} {sentence} {prose()}" for sentence, _ in licenses.TEMPLATES.values())
    rows = [(1, notices)] + [(10 + i, sentence(draw, 20)) for i in range(20)]
    found = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "labels")
    assert found[1][0][0] == sorted(licenses.TEMPLATES)
    assert all(found[i][0][0] == [] for i in range(10, 30))


def plain_labels(texts_):
    """The labels and best shares that the rule of votes gives, by going over every region of every text."""
    vocab, held = set(licenses.vocabulary()), [words_of(t) for t in texts_]
    df = Counter(w for ws in {(i, t) for i, t in enumerate(texts_)} for w in set(words_of(ws[1])) & vocab)
    idf = {w: math.log((len(held) + 1) / n) for w, n in df.items()}
    out = []
    for ws in held:
        named = {p: label for p, label in licenses.BASE.items() if any(ws[k : k + len(p.split())] == p.split() for k in range(len(ws)))}
        labels, best = set(named.values()), None
        for label, (told, keys) in licenses.TEMPLATES.items():
            regions = defaultdict(set)
            for at, w in enumerate(told.split()):
                for pos in (k for k, x in enumerate(ws) if x == w and w in vocab):
                    start = pos - at
                    for region in (("a", start // licenses.REGION), ("b", (start + licenses.REGION // 2) // licenses.REGION)):
                        regions[region].add((start, w))
            for marks in regions.values():
                rare = sorted({(idf[w], w) for _, w in marks}, reverse=True)[: licenses.RARE]
                for start in {s for s, _ in marks}:
                    mine = [v for v, w in rare if (start, w) in marks]
                    share = round(sum(mine) / sum(v for v, _ in rare), 9) if sum(v for v, _ in rare) else 0
                    near = all(any(ws[k : k + len(p.split())] == p.split() and abs(k - len(told[: f" {told} ".index(f" {p} ")].split()) - start) <= licenses.SLACK for k in range(len(ws))) for p in keys)
                    if len(mine) >= licenses.VOTERS and share >= licenses.SHARE and near:
                        labels.add(label)
                        best = max(best or 0, share)
        out.append((sorted(labels), round(0.5 + 0.5 * (best or 0), 6) if labels else 0.0))
    return out


def test_license_votes_equal_plain_votes(spark):
    """Templates with words changed, put in and left out, in prose of licence words; several labels a text."""
    draw, rows = random.Random(31), []
    prose = [*licenses.vocabulary(), *("lorem ipsum dolor sit amet elit".split() * 12)]
    for _ in range(120):
        text = draw.choices(prose, k=draw.randint(0, 150))
        for label in draw.sample(sorted(licenses.TEMPLATES), draw.randint(0, 3)):
            told = licenses.TEMPLATES[label][0].split()
            for _ in range(draw.choice([0, 0, 1, 2, 5])):
                k = draw.randrange(len(told))
                told[k : k + 1] = draw.choice([[], ["other"], [told[k], "more", "words"]])
            text += told + draw.choices(prose, k=draw.randint(0, 90))
        rows.append(" ".join(text))
    found = by_id(licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")), "labels", "score")
    want = plain_labels(rows)
    assert [(found[i][0][0], round(found[i][0][1], 6)) for i in range(len(rows))] == want
    assert len({tuple(x) for x, _ in want}) > 20


def plain_spans(text):
    """The base kinds as their definition says, with every match made first and dropped after."""
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def secret_rows():
    draw = random.Random(6)
    parts = ["password", "PassWD", "token", "api_key", "apikey", "secret", "=", ": ", '"', "'", " ", "AKIA", "A1B2C3", "ABCDEFGHIJ", "deadbeef", "0123456789abcdef", "é", "x.y", "-", "_", "\n", "==", "ſecret=abcdefghij"]
    rows = [(400 + i, "".join(draw.choices(parts, k=draw.randint(1, 14)))) for i in range(600)]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows += [(2000 + i, "see " + "".join(draw.choices(alphabet, k=40)) + " there") for i in range(60)]
    rows += [(3000 + i, "see " + "".join(draw.choices(["lorem", "ipsum", "dolor", "sit"], k=8)) + " there") for i in range(60)]
    return [*corpus(), *rows]


def test_secrets(spark):
    rows = secret_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(4)
    found = by_id(secrets.secrets(df), "base", "spans")
    assert sum(map(len, found.values())) == len(rows)
    caught = Counter()
    for i, t in rows:
        want = plain_spans(t or "")
        assert want in [[tuple(s) for s in base] for base, _ in found[i]], (i, t)
        for base, spans in found[i]:
            assert set(map(tuple, base)) <= set(map(tuple, spans)) and [s.start for s in spans] == sorted(s.start for s in spans)
            caught[(i or 0) // 1000] += any(s.kind == "random" for s in spans)
    assert caught[2] >= 50 and caught[3] == 0
    assert secrets.secrets(empty(spark)).collect() == []


def test_a_long_run_is_one_secret():
    draw = random.Random(8)
    blob = "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1600))
    text = f"see {blob} there"
    (kind, start, end, stratum, p), = secrets.candidates(text, [])
    assert (kind, start, end) == ("random", 4, 1604) and p > 0.001
    assert secrets.covered(text, {stratum: 0.001}) == "see [random] there"
    mixed = "0123456789abcdef" * 2 + "Z" + blob  # a base span at the start leaves the rest
    assert [r[1:3] for r in secrets.candidates(mixed, secrets.base_spans(mixed))] == [(32, 1633)]


def test_a_token_glued_into_an_address_is_a_part_of_its_run():
    draw = random.Random(12)
    token = "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36))
    assert secrets.tested(token, 0, 36)
    for text in (f"/api_v1/hooks/{token}", f"see /api_v1/hooks/{token}/edit now", f"key_name/of_{token}", f"some-long-lower-case-words-and-more/{token}"):
        assert any(token in text[start:end] and end - start <= len(token) + 3 for _, start, end, _, _ in secrets.candidates(text, [])), text
    words = "/some_long/path-of_lower/case_words" * 30_000  # 1 MB in one run
    assert secrets.candidates(words, []) == []
    many = f"password={token[:12]} {token} " * 20_000
    assert len(secrets.candidates(many, secrets.base_spans(many))) == 20_000


def plain_share(p, near):
    """The likeliest share by trying all: each p between two edges is even in itself or in its logarithm."""
    edges = [*secrets.EDGES, 1.0]
    cells = Counter(next(i for i in range(len(edges) - 2, -1, -1) if x >= edges[i]) for x in p)

    def likelihood(s):
        chance = [s * (b - a) / 0.999 + (1 - s) * math.log(b / a) / math.log(1000) for a, b in zip(edges, edges[1:])]
        return sum(n * math.log(chance[i]) for i, n in cells.items()) + 2 * (near * math.log(s) + (1 - near) * math.log(1 - s))

    return max((i / 4000 for i in range(1, 4000)), key=likelihood)


def counted(p):
    return [sum(lo <= x < hi for x in p) for lo, hi in zip(secrets.EDGES, [*secrets.EDGES[1:], 1.1])]


def test_limits_of_small_and_large_strata():
    one = lambda p: secrets.limits_of({"hex:0": counted(p)}).get("hex:0", 2.0)
    assert one([0.3]) <= 0.3 and one([0.2, 0.3, 0.4]) <= 0.2  # a few random runs are found
    assert 0.0012 < one([0.7, 0.0012]) <= 0.7 and 0.002 < one([0.9, 0.8, 0.0012, 0.002])  # what lies near 0 is not
    draw = random.Random(13)
    false = accepted = kept = there = 0
    for turn in range(400):
        strata = {f"{kind}:{band}": ([draw.random() for _ in range(draw.choice([0, 1, 5, 40, 400]))], [draw.random() ** 12 for _ in range(draw.choice([0, 1, 5, 40, 400]))])
                  for kind in ("hex", "base64") for band in range(3)}
        plain = {k: [x for x in a + b if x >= secrets.LEAST] for k, (a, b) in strata.items()}
        found = secrets.limits_of({k: counted(p) for k, p in plain.items()})
        for k, (a, b) in strata.items():
            low = found.get(k, 2.0)
            false, accepted = false + sum(x >= low for x in b), accepted + sum(x >= low for x in a + b)
            kept, there = kept + sum(x >= low for x in a), there + len(a)
            if turn < 8:
                near, other = ([x for j, p in plain.items() if j != k and (j[:3] == k[:3]) == same for x in p] for same in (True, False))
                prior = secrets.random_share(counted(near), secrets.random_share(counted(other), 0.9))
                share = secrets.random_share(counted(plain[k]), prior)
                assert abs(plain_share(near, plain_share(other, 0.9)) - prior) < 0.01 and abs(plain_share(plain[k], prior) - share) < 0.002
                rate = lambda t: (1 - share) * math.log(1 / t) / math.log(1000) / ((1 - share) * math.log(1 / t) / math.log(1000) + share * (1 - t) / 0.999)
                fits = [t for t in secrets.EDGES if rate(t) <= 0.1 and (1 - share) / math.log(1000) / t <= share / 0.999]
                assert found.get(k) == (fits[0] if fits else None)
    assert false / accepted < secrets.RATE and kept / there > 0.75, (false, accepted, kept, there)


def test_p_values_of_random_draws_are_even():
    draw = random.Random(14)
    for _, alphabet in secrets.ENCODINGS:
        for n in (24, 64, 400):
            p = [secrets.randomness("".join(draw.choices(alphabet, k=n)), alphabet) for _ in range(1500)]
            assert all(abs(sum(x >= t for x in p) / len(p) - (1 - t)) < 0.07 for t in (0.05, 0.25, 0.5, 0.75)), (alphabet, n)
        assert secrets.randomness(alphabet[:2] * 20, alphabet) < 1e-3



def test_redaction_keeps_rows_and_other_text(spark):
    df = spark.createDataFrame([(1, "a token=abcdefghij b", "x"), (2, None, None), (3, "clean", "y"), (3, "clean", "y")], "doc_id long, text string, spans string")
    found = sorted((tuple(r) for r in secrets.redact(df).collect()), key=str)
    assert found == sorted([(1, "a [assign] b", "x"), (2, None, None), (3, "clean", "y"), (3, "clean", "y")], key=str)


def test_fingerprints_of_edits(spark, docs):
    rows = sorted(((i, t or "") for i, t in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = fingerprints.compare_with_edits(docs).collect()
    assert len(found) == len(rows)
    want = Counter()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        want[(i, len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    marks = {}
    for i, t in corpus():
        marks.setdefault(t or "", set()).add(fingerprints.fingerprint(t))
    assert all(len(m) == 1 for m in marks.values())
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert fingerprints.compare_with_edits(empty(spark)).collect() == []
    alone = fingerprints.compare_with_edits(spark.createDataFrame([(1, "ab" * 40)], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def test_likeness_is_the_edit_distance_of_chunks():
    draw = random.Random(3)
    for _ in range(200):
        a, b = ("".join(x + x for x in draw.choices("abc", k=draw.randint(0, 9))) for _ in range(2))
        table = np.zeros((len(a) // 2 + 1, len(b) // 2 + 1), int)
        for i, j in itertools.product(range(1, table.shape[0]), range(1, table.shape[1])):
            table[i, j] = table[i - 1, j - 1] + 1 if a[2 * i - 2] == b[2 * j - 2] else max(table[i - 1, j], table[i, j - 1])
        assert fingerprints._common(a, b) == table[-1, -1]
    text = sentence(draw, 3000)
    same, other = fingerprints.fingerprint(text), fingerprints.fingerprint(sentence(draw, 3000))
    assert fingerprints.likeness(same, fingerprints.fingerprint(text[:9000] + "!" + text[9000:])) > 0.8 > 0.2 > fingerprints.likeness(same, other)


def test_decontamination_marks_every_covered_word(spark, docs):
    rows = corpus()
    items = [(1, " ".join(rows[10][1].split()[:14])), (2, rows[70][1].upper()), (11, "one two"), (12, None), (13, "--"), (14, "one two"), (15, rows[120][1]), (15, rows[121][1]), (None, rows[11][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    found = by_id(decontamination.decontaminate(docs, bench), "n_words", "n_hit", "items", "contaminated")
    assert sum(map(len, found.values())) == len(rows)
    for i, t in rows:
        w, hit, named = words_of(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        want = (len(w), len(hit), sorted(str(x) for x in named if x is not None), bool(hit))
        assert want in found[i], (i, t, want, found[i])
    assert decontamination.decontaminate(empty(spark), bench).collect() == []
    none = decontamination.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.toxicity(documents.join(labels.select("doc_id"), "doc_id"), labels).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    english = {r.doc_id for r in documents.filter("lang = 'en'").select("doc_id").collect()}  # at this size only English toxic rows differ from others at all
    right = lambda rows: sum(r.predicted == told[r.doc_id] for r in rows) / len(rows)
    assert right(held) > 0.93 and right([r for r in held if not told[r.doc_id]]) > 0.99 and right([r for r in held if r.doc_id in english]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_toxicity_finds_each_language(spark):
    """The language stands in the test alone; markers that ordinary texts hold once by chance must tell as well."""
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = {r.doc_id: (r.lang, r.toxic) for r in documents.join(labels, "doc_id").select("doc_id", "lang", "toxic").collect()}
    held = [r for r in toxicity.toxicity(documents.join(labels.select("doc_id"), "doc_id"), labels).collect() if r.held_out]
    assert sum(r.predicted == told[r.doc_id][1] for r in held) / len(held) > 0.95
    for lang in ("en", "de", "fr", "es"):
        own = [(r.predicted, told[r.doc_id][1]) for r in held if told[r.doc_id][0] == lang]
        recall, rest = ([p == t for p, t in own if t == k] for k in (1, 0))
        assert sum(recall) / len(recall) >= 0.6 and sum(rest) / len(rest) > 0.95, (lang, sum(recall), len(recall), sum(rest), len(rest))


def test_toxicity_of_odd_tables(spark, docs):
    kind = "doc_id long, toxic int, text string"
    none = spark.createDataFrame([], kind)
    few = spark.createDataFrame([(i, i % 2, "x") for i in range(20)] + [(None, 1, None), (3, None, None), (500, 1, None)], kind)
    for labels in (none, few):
        found = toxicity.toxicity(docs, labels).collect()
        assert len(found) == len(corpus()) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity(empty(spark), few).collect() == []


def test_language_of_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("host", F.lit(1)).withColumn("lang", F.lit("zz"))
    odd = spark.createDataFrame([(9001, None, None), (9002, "", ""), (9003, "no address", "<html lang=de><p>" + "der die und " * 30), (9003, "no address", "<html lang=de>")], "page_id long, url string, html string")
    found = language.detect(pages.select("page_id", "url", "html", "host", "lang").unionByName(odd, allowMissingColumns=True), spark.read.parquet(f"{sf}/documents.parquet")).collect()
    told = {r.page_id: r.url.split("/")[3].split("?")[0] for r in pages.collect()}
    right = [r.lang == told[r.page_id] for r in found if r.page_id in told]
    assert len(found) == len(told) + 4 and sum(right) / len(right) > 0.97
    assert all(r.lang for r in found)
    assert [r.lang for r in language.detect(odd, empty(spark).withColumn("lang", F.lit("en"))).collect()] == [None] * 4
    assert language.detect(odd.limit(0), spark.read.parquet(f"{sf}/documents.parquet")).collect() == []


def plain_visible(html):
    """Tags, comments and hidden elements taken out step by step; an unclosed one runs to the end."""
    out, i, low = [], 0, html.lower()
    while i < len(html):
        name = next((n for n in ("script", "style", "noscript", "template") if re.match(rf"<{n}\b", low[i:])), None)
        if low.startswith("<!--", i) or name:
            end = re.compile(rf"</{name}\s*>" if name else "-->").search(low, i + (4 if not name else len(name) + 1))
            i = end.end() if end else len(html)
            out.append(" ")
        else:
            out.append(html[i])
            i += 1
    return re.sub(r"<[^>]*>", " ", "".join(out))


@pytest.mark.parametrize("html", ["a<b>c</b>", "x<script>y</script >z", "x<SCRIPT src=1>y</script>z<!-- c -->w", "a<!-- b", "a<style>b", "<p>1 < 2", "<scripted>a</scripted>", "a<!--b--><!--c-->d", "<template><script></template>e", ""])
def test_visible_text(html):
    assert language.visible(html).split() == plain_visible(html).split()


@pytest.mark.parametrize("part", ["<!-- ", "<script>", "<", "<html ", "<html><", "</script ", "<p>a</p>", "<style "])
def test_long_pages_are_passed_once(part):
    page = part * ((1 << 20) // len(part))
    began = time.process_time()
    language.visible(page)
    language.declared_language(page)
    assert time.process_time() - began < 5
    assert language.declared_language("<html class=x><html\nlang='DE' >") == "de" and language.declared_language("<p lang=de>") is None


def test_fingerprints_of_one_id(spark):
    """Rows of one id are spread over tasks and still compared with the next by text."""
    rows = [(1 if i % 3 else None, f"{i % 41} " * 30) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in fingerprints.compare_with_edits(df).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 2
        want.append((i is not None, i or 0, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert found == sorted(want)


def test_likelihood_base_and_counts(spark, docs, monkeypatch):
    monkeypatch.setattr(likelihood, "FREQUENT", 20)
    rows = corpus()
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [likelihood.END]
    training = [split(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for r in training for w in r)
    n, v = sum(counts.values()), len(counts)
    found = by_id(likelihood.scores(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert sum(map(len, found.values())) == len(rows)
    for i, t in rows:
        w = split(t)
        want = (i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert any(x[:4] == want and math.isclose(x[4], base, rel_tol=1e-9) for x in found[i]), (i, want, base, found[i])
        assert all(math.isfinite(x[5]) and x[5] < 0 for x in found[i])
    assert likelihood.scores(empty(spark)).collect() == []


def test_likelihood_is_normalised():
    voc = likelihood.Vocabulary({b" ": 0, b"a": 1, b"b": 2, b"rare": 3}, np.array([5, 9, 4, 1]), 3, 22, 6)
    scorer = likelihood.Scorer(likelihood.Net(3), voc)
    for one, two in itertools.product(range(5), repeat=2):
        logs = scorer.logs(np.arange(4), np.full(4, one), np.full(4, two))
        assert abs((10.0**logs).sum() - 1) < 1e-5
    others = [1, 2, 1, 0]  # counts of the three other known tokens, and one unseen type
    assert abs(sum((c + 1) / 10 ** voc.other_log() for c in others) - 1) < 1e-9


def _token_model(monkeypatch, beyond=6):
    """A vocabulary of two classes, ten tokens with cells of their own and some outside the table, with a drawn model."""
    monkeypatch.setattr(likelihood, "CLASSES", 2)
    words = [b" ", b"the", b"of", *(f"{x}{y}".encode() for x in ("ba", "co", "di", "fu", "gy") for y in ("ment", "tion"))]
    count = np.arange(40, 40 - len(words), -1)
    outside = {f"rare{i}".encode(): i + 1 for i in range(beyond)}
    voc = likelihood.Vocabulary({w: i for i, w in enumerate(words)}, count, 3, int(count.sum()) + sum(outside.values()), len(words) + beyond)
    layout = likelihood.Cells(voc)
    mass = Counter()
    for w, c in outside.items():
        mass[layout.hashed_cell(w)] += c + 1
    layout.weigh(mass)
    net, draw = likelihood.Net(3, layout.sizes), np.random.default_rng(2)
    for x in net.arrays():
        x += draw.normal(0, 0.5, x.shape).astype(np.float32)
    return voc, layout, net, words, outside


def _log_of_last(scorer, voc, layout, text):
    ranks, ends = voc.ranks(text), np.array([len(text)])
    cell = layout.of(text, ranks)
    return scorer.token_logs(*likelihood.contexts(ranks, ends, voc, scorer.net.start), cell, *likelihood._before(cell, ends, -1))[-1], cell[-1]


@pytest.mark.parametrize("scale", [1, 60])
def test_likelihood_of_all_tokens_is_normalised(monkeypatch, scale):
    """Classes, tokens of the table, tokens outside it and one unseen type in each hashed cell sum to 1 after any context, also with large scores."""
    voc, layout, net, words, outside = _token_model(monkeypatch)
    for x in (net.r, net.q, net.r0, net.r1, net.r2):
        x *= scale**0.5
    scorer = likelihood.Scorer(net, voc, layout)
    for before in ([], [b"the"], [b"bament", b"of"], [b"rare1", b"dition"], [b"unseen", b"rare5"]):
        total, hashed = 0.0, set()
        for w in words:
            log, _ = _log_of_last(scorer, voc, layout, [*before, w])
            total += 10**log
        for w, c in outside.items():
            log, _ = _log_of_last(scorer, voc, layout, [*before, w])
            total += 10**log * (c + 1)
        for i, end in itertools.product(range(40), words[3:]):  # an unseen word for each hashed cell
            w = f"{i}".encode() + end
            cell = layout.hashed_cell(w)
            if cell not in hashed:
                hashed.add(cell)
                log, _ = _log_of_last(scorer, voc, layout, [*before, w])
                total += 10**log
        assert len(hashed) == layout.side**2 * layout.hashed
        assert abs(total - 1) < 1e-4, (before, total)


def test_likelihood_tells_rare_tokens_apart(monkeypatch):
    """No token shares its vectors with all others: outside the classes too, a target is weighed by its context and a context weighs its targets."""
    voc, layout, net, words, _ = _token_model(monkeypatch)
    scorer = likelihood.Scorer(net, voc, layout)
    log = lambda *text: _log_of_last(scorer, voc, layout, list(text))[0]
    rare = words[3:]
    assert len({layout.of([w], voc.ranks([w]))[0] for w in rare}) == len(rare)
    assert len({round(float(log(w, b"the")), 4) for w in rare}) == len(rare)
    gains = {round(float(log(b"of", w) - log(b"the", w)), 4) for w in rare}
    assert len(gains) == len(rare)


def test_powers_grow_with_the_tables_and_not_with_the_texts(monkeypatch):
    """Normalisers of contexts with cells are sums of products of table rows: no scores are raised for each token, and the sums are those of the scores."""
    voc, layout, net, words, _ = _token_model(monkeypatch)
    scorer = likelihood.Scorer(net, voc, layout)
    raised, norm = [], likelihood.Scorer._norm
    monkeypatch.setattr(likelihood.Scorer, "_norm", lambda self, p, *more: raised.append(len(p)) or norm(self, p, *more))
    draw = np.random.default_rng(4)
    text = [words[i] for i in draw.integers(1, len(words), 3000)]
    ranks, ends = voc.ranks(text), np.array([len(text)])
    cell, (word, one, two) = layout.of(text, ranks), likelihood.contexts(ranks, ends, voc, net.start)
    cell_one, cell_two = likelihood._before(cell, ends, -1)
    found = scorer.token_logs(word, one, two, cell, cell_one, cell_two)
    assert sum(raised) <= scorer.side**2
    vector = lambda c, d: net.q[c] + (net.q0[d // layout.places // layout.side] + net.q1[d // layout.places] + net.q2[d % layout.places] if d >= 0 else 0)
    for i in range(0, 3000, 50):
        p = (vector(one[i], cell_one[i]) * net.place[0] + vector(two[i], cell_two[i]) * net.place[1]).astype(float)
        scores = net.r @ p + net.bias
        want = scores[word[i]] - np.log(np.exp(scores).sum())
        if cell[i] >= 0:
            part, place = divmod(int(cell[i]), layout.places)
            group = part // layout.side
            for k, (digit, above) in enumerate(((group, 0), (part % layout.side, group), (place, part))):
                scores = getattr(net, f"r{k}") @ p + getattr(net, f"bias{k}") + layout.log_shares[k][above]
                want += scores[digit] - np.log(np.exp(scores).sum())
        assert math.isclose(found[i], want / math.log(10), rel_tol=1e-4), i


def test_tokens_are_looked_up_by_distinct_token(monkeypatch):
    """Words, ranks, cells and rare tokens of texts as Python splits them, whatever the blanks; parts by the last bytes as by the whole word."""
    voc, layout, _, words, _ = _token_model(monkeypatch)
    rows = ["", None, " \t\n", "THE of\x0bbament\x0cquux\r\n", "caf\u00e9\u00a0ÄB\u2003x \x1cquux quux \x00", "ment xment bament\x00 \x00bament longbament é", "the"]
    split = [(x or "").encode().lower().split() + [b" "] for x in rows]
    flat = [w for row in split for w in row]
    for column in (pa.array(rows), pa.array(["zz", *rows])[1:]):
        found = likelihood.tokens(column, voc, layout)
        assert found.ends.tolist() == list(itertools.accumulate(map(len, split)))
        assert (found.ranks == voc.ranks(flat)).all() and (found.cell == layout.of(flat, voc.ranks(flat))).all()
        assert [found.rare[int(i)].as_py().encode() for i in found.rare_code] == [w for w in flat if w not in voc.rank]
        assert found.rare_at.tolist() == [i for i, w in enumerate(flat) if w not in voc.rank]
    draw = np.random.default_rng(5)
    odd = [bytes(draw.choice(list(b"nt\0aim"), draw.integers(1, 12))).decode() for _ in range(500)] + [f"x{b[::-1].decode()}" for b in layout.bounds] + [b[::-1].decode() for b in layout.bounds]
    assert layout.hashed_cells(pa.array(odd)).tolist() == [layout.hashed_cell(w.encode()) for w in odd]
    empty = likelihood.tokens(pa.array([None, ""], pa.string()), voc, layout)
    assert empty.ranks.tolist() == [0, 0] and len(empty.rare_at) == 0


def test_training_learns_rare_tokens(monkeypatch):
    """Two tokens without a class that always stand together become likely together."""
    voc, layout, _, words, _ = _token_model(monkeypatch)
    text = [b"bament", b"cotion", b"the", b"dition", b"fument", b"of"] * 3000
    ranks, ends = voc.ranks(text), np.array([len(text)])
    net = likelihood.Net(3, layout.sizes)
    cell = layout.of(text, ranks)
    columns = (*likelihood.contexts(ranks, ends, voc, net.start), cell, *likelihood._before(cell, ends, -1))
    start = likelihood.Scorer(net, voc, layout).token_logs(*(x[300:600] for x in columns)).mean()
    squares, draw, noise = [np.full(a.shape, 1.0) for a in net.arrays()], np.random.default_rng(0), np.full(4, np.log(0.25), np.float32)
    for i in range(0, len(text), 300):
        word, one, two, *inner = (x[i : i + 300] for x in columns)
        likelihood.descend(net, squares, noise, draw.integers(0, 4, 16), word, one, two, layout, [draw.integers(0, n, 8) for n in layout.sizes], inner)
    assert likelihood.Scorer(net, voc, layout).token_logs(*(x[300:600] for x in columns)).mean() > start / 3


def test_training_beats_the_shares():
    draw = np.random.default_rng(0)
    voc = likelihood.Vocabulary({b" ": 0, b"a": 1, b"b": 2, b"c": 3}, np.array([10, 1000, 1000, 1000]), 4, 3010, 4)
    word = np.tile([1, 2, 3], 20_000)
    one, two = np.r_[5, word[:-1]], np.r_[5, 5, word[:-2]]
    net = likelihood.Net(4)
    noise = np.log(voc.shares()).astype(np.float32)
    squares = [np.full(a.shape, 1.0) for a in (net.r, net.q, net.place, net.bias)]
    for i in range(0, len(word), 500):
        drawn = draw.choice(5, 16, p=voc.shares())
        likelihood.descend(net, squares, noise, drawn, word[i : i + 500], one[i : i + 500], two[i : i + 500])
    assert likelihood.Scorer(net, voc).logs(word[300:600], one[300:600], two[300:600]).mean() > -0.25
