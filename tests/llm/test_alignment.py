import hashlib
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import alignment

ODD = ["a  b   c ", " lead", "▁x y", "tab\t x  y", "<s> <|endoftext|> </s>", "é è ü 日本語 テスト x", "\x00 z \x01", "don't we'll  'S x's", "x\n\n y \r\n", "123 4567 89,1.5", " ", "  ", "é ́ x", "ﬁ ﬁne ①", "👍🏽 ok 👨‍👩‍👧", "<0x41> <0xE2> q", "a" * 3000, "ab 　   cd"]


def encoders():
    a, b = alignment.tokenizer_paths(None, None)
    one, two = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
    one.encode_special_tokens = True
    return one, two


def brute(texts):
    """Per text: numbers, groups by common ends, and links by comparing all intervals that may meet."""
    one, two = encoders()
    back = {c: bytes([k]) for c, k in alignment.byte_characters().items()}
    out, held = [], Counter()
    for t in texts:
        a, b = (one.encode(" " + t, add_special_tokens=False), two.encode(t)) if t else (None, [])
        a_ids = a.ids if a else []
        a_bytes = [t.encode() if t == "<|endoftext|>" else b"".join(back[c] for c in t) for t in (a.tokens if a else [])]
        b_bytes = [bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [two.id_to_piece(k)]]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            out.append(([], [], [], ""))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for x in parts:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        text, at = [], [0, 0]
        for e in ends:
            sides = []
            for k, (ids, own) in enumerate(zip((a_ids, b), spans)):
                begin = at[k]
                while at[k] < len(own) and own[at[k]][1] <= e:
                    at[k] += 1
                sides.append(",".join(map(str, ids[begin : at[k]])))
            text.append("|".join(sides))
        links, j = [], 0
        for k, (s, e) in zip(a_ids, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            i = j
            while i < len(b) and spans[1][i][0] < e:
                links.append((k, b[i]))
                i += 1
        out.append((a_ids, b, links, ";".join(text)))
        held.update(set(links))
    best = defaultdict(int)
    for (k, _), n in held.items():
        best[k] = max(best[k], n)
    return [(len(a), len(b), g.count(";") + bool(g), len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, x, g in out], [g for *_, g in out]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def held_against_brute(df, **more):
    rows = df.collect()
    want, texts = brute([r.text for r in rows])
    got = alignment.align(df, **more).collect()
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == Counter((r.doc_id, *w) for r, w in zip(rows, want))
    assert Counter((r.doc_id, r.groups) for r in alignment.groups(df).collect()) == Counter((r.doc_id, t) for r, t in zip(rows, texts))
    return got


def test_supplied_texts(docs):
    assert sum(r.n_a > 0 for r in held_against_brute(docs)) > 100


def test_odd_texts_in_small_blocks(spark, odd_docs):
    more = spark.createDataFrame([(k + 100, t) for k, t in enumerate(ODD)] + [(None, "no id"), (None, None)], "doc_id long, text string")
    rows = held_against_brute(odd_docs.select("doc_id", "text").unionByName(more).repartition(3), block_entries=20)
    assert sum(r.doc_id == 0 for r in rows) == 2
    assert {r.n_a for r in rows if r.doc_id == 102} == {0}  # U+2581 comes back as a space


def test_clashing_names_and_empty(odd_docs, no_docs):
    df = odd_docs.selectExpr("doc_id", "text", "1 as block", "2 as pairs", "3 as n_a", "4 as _text")
    assert alignment.align(df).count() == odd_docs.count()
    assert alignment.align(no_docs).count() == alignment.groups(no_docs).count() == 0


@pytest.mark.parametrize("limit", [0, 10**9])
def test_cache_and_units_change_nothing(docs, limit, monkeypatch):
    """Forgetting all units after each batch, and taking whole texts as units, gives the same."""
    import pyarrow as pa

    texts = pa.array([r.text for r in docs.limit(60).collect()] + ODD, pa.large_string())
    monkeypatch.setattr(alignment, "CACHE_UNITS", limit)
    paths = alignment.tokenizer_paths(None, None)
    cache, whole = alignment.Known(*paths), alignment.Known(*paths)
    whole.pair.local = False
    for k in range(0, len(texts), 20):
        one, two = (alignment.Batch(texts.slice(k, 20), x) for x in (cache, whole))
        assert one.groups.equals(two.groups)
        assert all((x == y).all() for x, y in zip(one.entries(), two.entries()))


def test_pair_counts(docs):
    """The counts of pairs by id, against sets of each document's links."""
    got = {r.pair: r["count"] for r in alignment.pair_counts(alignment.encoded(docs.limit(40))).collect()}
    assert max(got.values()) <= 40 and len(got) > 500
