"""Source divergence, tokenizer alignment and URL filters against brute force."""

import collections
import itertools
import random
import re

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, divergence, queries, url_rules

DOCS = "doc_id long, text string, lang string, source string, id string, term string, n long, batch string"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], DOCS)


def divergence_by_hand(rows, least_docs, top):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "")) for _, t, _, _ in rows]
    terms = [["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in own] for own in terms]
    rows = [(lang or "", source or "", own) for (_, _, lang, source), own in zip(rows, terms, strict=True)]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen = collections.Counter(w for _, _, ws in own for w in set(ws))
        kept = [w for w, n in seen.items() if n >= least_docs]
        count = {s: collections.Counter(w for _, t, ws in own if t == s for w in ws if seen[w] >= least_docs) for s in {r[1] for r in own}}
        whole = sum(count.values(), collections.Counter())

        def p(c):
            return {w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept)) for w in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            pairs = [(-sum(f(ps[s][w], ps[t][w]) for w in kept), t.encode()) for t in count if t != s]
            typical = [(-f(ps[s][w], q[w]), w.encode()) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(typical)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_terms, block_groups", [(1024, 128), (3, 2)])
def test_divergence_equals_brute_force(spark, block_terms, block_groups):
    rng = random.Random(block_terms)
    words = ["The", "été", "don't", "x1y", "日本", "ß", "zebra", "of", "UND", "a-b"]
    rows = [(i, " ".join(rng.choices(words, range(10, 0, -1), k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "s4", "s5", None])) for i in range(150)]
    rows += [(1000, None, "en", "silent"), (1001, "", "empty", "only"), (1002, "1 2 3", "empty", "other"), (1003, "lone words", "one", "s1"), (1004, "the " * 50_000, "en", "s1"), (1004, "the " * 50_000, "en", "s1"), (None, "of the", "en", "s2")]
    got = divergence.source_divergence(documents(spark, rows), least_docs=5, top=3, block_terms=block_terms, block_groups=block_groups)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, 5, 3)


def test_divergence_of_no_rows(spark):
    assert divergence.source_divergence(documents(spark, [])).count() == 0


def test_divergence_agrees_with_its_sql(spark):
    rows = [(i, f"word{'abcdefghij'[i % 7]} the Éa {'x' * (i % 3)}", ["en", None][i % 2], f"s{i % 3}") for i in range(80)]
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    got = divergence.source_divergence(documents(spark, rows)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(queries.ORACLE["op11_source_divergence"]).fetchall())


def test_shares_are_exact_for_large_counts():
    import numpy as np

    counts, total = [0, 1, 10**9, 8 * 10**15 - 7], 8 * 10**15
    got = divergence.shares(np.array(counts), total, 12345)
    assert got.tolist() == [1 + 10**9 * (n + 2) // (total + 2 * 12345) for n in counts]


def alignment_by_hand(texts):
    a, b, alphabet = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), alignment.byte_alphabet()
    a.encode_special_tokens = True
    linked, found = collections.Counter(), []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(map(alphabet.__getitem__, a.id_to_token(i))) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        links = [(x, y) for x, e, m in zip(ids_a, ends_a, bytes_a, strict=True) for y, f, n in zip(ids_b, ends_b, bytes_b, strict=True) if e - len(m) < f and f - len(n) < e]
        groups, at = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if at < e <= cut) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            at = cut
        linked.update(links)
        found.append((len(ids_a), len(ids_b), links, groups))
    best = {y: max(n for (_, z), n in linked.items() if z == y) for y in {y for _, y in linked}}
    rows = [(n_a, n_b, len(groups), len(links), sum(linked[x] == best[x[1]] for x in links), sum(linked[x] for x in links), ";".join(groups)) for n_a, n_b, links, groups in found]
    return rows, {(*x, n, n == best[x[1]]) for x, n in linked.items()}


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    pieces = ["the", "wonderful", "naïve", "日本語テキスト", "\U0001f600", "<|endoftext|>", "<s>", "<0x41>", "\n", "\t", " ", "  ", "don't", "x" * 40, " ", " y", "12345", "é", "\x00", "\x1d", "!?", "</s>", "<unk>"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) if i % 3 else " ".join(rng.choices(pieces, k=9)) for i in range(120)]
    texts += [None, "", " ", "\n", "a▁b", "the ▁ end", "the wonderful " * 1500, "q" * 5000, "the wonderful", "the wonderful"]
    monkeypatch.setattr(alignment, "BATCH_DOCS", 16)
    monkeypatch.setattr(alignment, "TASK_LINKS", 10)
    docs = documents(spark, [(i if i else None, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    short = [t for t in texts if not t or len(t) < 1000]
    got = alignment.align_documents(docs, *PATHS)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want, pairs = alignment_by_hand([t if t is None or len(t) < 30_000 else t for t in texts])
    assert len(short) == len(texts) - 2
    assert {r.id or 0: tuple(r)[1:] for r in got.collect()} == dict(enumerate(want))
    assert set(map(tuple, alignment.pair_counts(docs, *PATHS).collect())) == pairs


def test_alignment_of_no_rows_and_no_tokens(spark):
    assert alignment.align_documents(documents(spark, []), *PATHS).count() == 0
    assert alignment.pair_counts(documents(spark, []), *PATHS).count() == 0
    got = alignment.align_documents(documents(spark, [(1, None, "en", "s"), (2, "", "en", "s")]), *PATHS, groups="sha256").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_do_not_change_tokens():
    """A space beside any other character: the tokens of the chunks are those of the whole text."""
    pair = alignment.TokenizerPair(*PATHS)
    texts = [f"a{chr(c)} {chr(c)}b" for c in [*range(0x3100), 0xFEFF, 0xFFFD, 0x1F600]]
    for text, whole in zip(texts, pair.a.encode_batch(["  " + t for t in texts], add_special_tokens=False), strict=True):
        chunks = alignment._cut(" " + text)
        assert sum((e.ids for e in pair.a.encode_batch([" " + c for c in chunks], add_special_tokens=False)), []) == whole.ids, text
        if "▁" not in text:
            assert sum(pair.b.encode(chunks), []) == pair.b.encode(" " + text), text


def page(head):
    return f"<html><head>{head}</head><body><a href='/x'>x</a></body></html>"


PAGES = [
    (1, "http://Shop.Example.ORG/es/1", page("")),  # blocked by the longest rule
    (2, "https://mirror.example.net/a", page("<link href='http://shop.example.org/es/1' rel='canonical'>")),  # alias of 1
    (3, "https://far.example.net/b?q=1#top", page('<META content="0; URL=https://mirror.example.net/a" HTTP-EQUIV="Refresh">')),  # alias of 2
    (4, "http://org/en/1", page("<link rel=canonical href=https://far.example.net/b?q=1>")),  # allowed by rule, alias of 3
    (5, "http://www.example.org/en/17/x", page("")),  # blocked: /en/1 begins its path
    (6, "http://a.com/fr/x", page("<link rel=canonical href=/de/x>")),  # allowed, names a blocked page of its host
    (7, "http://a.com/it/x", page("<link rel=canonical href='../de/y'><link rel=canonical href=''>")),  # dot segments stay
    (8, "http://a.com/it/y", page("<link rel=canonical href='?p=1&amp;q=2'>")),
    (9, "http://a.com/it/y?p=1&q=2", page("<link rel=canonical href='z'>")),
    (10, "http://a.com/it/z", page("<link rel='canonical' href='//a.com/de/z'>")),  # 8, 9 and 10 are aliases of a URL without a page
    (11, "http://notexample.org.uk/es/", page("<link rel=canonical href='mailto:x@y'>")),
    (12, None, None),
    (13, "no scheme/de/", page("<link rel=canonical href=http://a.com/de/q>")),
    (14, "", ""),
    (15, "http://a.com?x=/de/", page("<link rel=stylesheet href=/de/x>")),
    (16, "http://a.com/de/" + "p" * 200_000, page("")),
    (17, "http://" + "a." * 3000 + "com/de/", page("")),
    (18, "HTTPS://MIRROR.example.net/a#frag", None),  # the address of 2
    (18, "HTTPS://MIRROR.example.net/a#frag", None),
    (None, "http://b.com/de/x", page("")),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "r", 1) for r in rows], "page_id long, url string, html string, host string, rule string, n long")


def test_url_filter_agrees_with_its_sql_and_plain_cases(spark):
    c = duckdb.connect()
    c.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    got = url_rules.judge_urls(pages(spark, PAGES), queries.RULES)
    rows = got.collect()
    assert got.columns == ["id", "host", "path", "rule", "verdict", "aliased"]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, c.sql(queries.ORACLE["op13_url_filter"]).fetchall()))
    by = {r.id: (r.rule, r.verdict, r.aliased) for r in rows}
    assert by[1] == ("example.org/es/", "block", False) and by[2] == (None, "block", True) == by[3] == by[18]
    assert by[4] == ("org/", "allow", False) and by[6] == ("com/fr/", "allow", False) and by[5][0] == "example.org/en/1"
    assert by[8] == by[9] == by[10] == (None, "block", True)
    assert by[7] == by[11] == by[12] == by[13] == by[14] == by[15] == (None, "allow", False)
    assert by[16] == by[17] == ("com/de/", "block", False)


def test_url_filter_with_many_rules_hot_hosts_and_given_links(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 3)
    rows = [(i, f"http://hot.com/{'de' if i % 2 else 'it'}/{i % 50}", None) for i in range(600)]
    chain = spark.createDataFrame([(f"http://c.net/{i}", f"http://c.net/{i + 1}") for i in range(20)] + [("http://c.net/20", "http://hot.com/de/1")], "src string, dst string")
    rows += [(1000 + i, f"http://c.net/{i}", None) for i in range(21)]
    got = url_rules.judge_urls(pages(spark, rows), queries.RULES, chain).collect()
    assert len(got) == 621
    assert all((r.verdict == "block") == (r.id % 2 == 1 or r.id >= 1000) for r in got)
    assert url_rules.judge_urls(pages(spark, rows[:5]), []).where("verdict = 'allow'").count() == 5
    assert url_rules.judge_urls(pages(spark, []), queries.RULES).count() == 0
