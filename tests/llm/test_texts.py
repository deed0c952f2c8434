import random
from collections import Counter

import pytest

from strandlake.llm import mail, mixing, packing, quality, tokens

SIZES = "doc_id bigint, n_tokens bigint, container_id int"


def packs_of(spark, *capacities):
    return spark.createDataFrame([(f"c{c}", c) for c in capacities], "pack_name string, capacity_tokens int")


def best_fit_decreasing(sizes, capacity):
    free = []
    for x in sorted(sizes, reverse=True):
        fitting = [i for i, f in enumerate(free) if f >= x]
        if fitting:
            free[min(fitting, key=free.__getitem__)] -= x
        else:
            free.append(capacity - x)
    return len(free)


def test_packing_keeps_every_item(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, None, 1, 7, 50, 50, 99, 100, 101, 250, rnd.randint(1, 130)]), 5) for i in range(700)]
    rows += [(1, 50, 5), (1, 50, 5)]
    packs = packs_of(spark, 100, 64)
    out = packing.pack(spark.createDataFrame(rows, SIZES), packs, salts=3)
    got = out.collect()
    for name, capacity in (("c100", 100), ("c64", 64)):
        mine = [r for r in got if r.pack_name == name]
        assert Counter(r.doc_id for r in mine) == Counter(i for i, n, _ in rows for _ in range(max(1, -(-(n or 0) // capacity))))
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n, _ in rows)
        fill = Counter()
        for r in mine:
            fill[r.container_id] += r.n_tokens
            assert r.token_from == r.piece_no * capacity and (r.n_tokens == capacity or r.token_from + r.n_tokens in {n or 0 for i, n, _ in rows if i == r.doc_id})
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        assert len(fill) <= best_fit_decreasing([r.n_tokens for r in mine if r.n_tokens], capacity) + 1
    filled = packing.fills(out, packs)
    assert filled.where("used_tokens > capacity_tokens").count() == 0


def test_packing_of_odd_tables(spark):
    assert packing.pack(spark.createDataFrame([], SIZES), packs_of(spark, 10)).count() == 0
    only_empty = packing.pack(spark.createDataFrame([(1, 0, 1), (2, None, 1)], SIZES), packs_of(spark, 10)).collect()
    assert {(r.doc_id, r.container_id, r.n_tokens) for r in only_empty} == {(1, 0, 0), (2, 0, 0)}
    with pytest.raises(ValueError, match="capacities"):
        packing.pack(spark.createDataFrame([(1, 1, 1)], SIZES), packs_of(spark, 0))


def test_exact_complements():
    assert packing.plan({7: 1, 2: 1, 1: 1}, 10) == [((7, 2, 1), 1)]
    assert packing.plan({5: 4}, 10) == [((5, 5), 2)]
    assert packing.plan({4: 5, 2: 1}, 10) == [((4, 4, 2), 1), ((4, 4), 1), ((4,), 1)]
    for seed in range(30):
        rnd = random.Random(seed)
        histogram = Counter(rnd.randint(1, 40) for _ in range(rnd.randint(1, 120)))
        patterns = packing.plan(dict(histogram), 40)
        used = Counter()
        for lengths, times in patterns:
            assert sum(lengths) <= 40 and times > 0
            for x in lengths:
                used[x] += times
        assert used == histogram


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["web", "WEB ", "Code-Base", "code base", "tiny", None, "other"]), rnd.randint(0, 40)) for i in range(4000)]
    rows = [(i, s if s != "tiny" or i % 20 == 0 else "web", n) for i, s, n in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "1 AS copies", "2 AS fraction", "3 AS hashed")
    targets = spark.createDataFrame([("web", 0.5, 1), ("code_base", 0.3, 2), ("TINY", 0.2, 4), ("absent", None, None)], "source string, target_share double, max_repeats int")
    documents, shares = mixing.mix(docs, targets, fractions=(0.2, 1.0))
    got = documents.collect()
    full = {r.doc_id: r.copies for r in got if r.fraction == 1.0}
    part = {r.doc_id: r.copies for r in got if r.fraction == 0.2}
    assert set(part) <= set(full) and all(part[d] <= full[d] for d in part)  # nested
    caps = {"web": 1, "code_base": 2, "tiny": 4}
    assert all(r.copies <= caps[r.source] for r in got)
    report = {r.source: r for r in shares.collect() if r.fraction == 1.0}
    assert set(report) == {"web", "code_base", "tiny", "absent"}
    for s, target in (("web", 0.5), ("code_base", 0.3), ("tiny", 0.2)):
        assert abs(report[s].reached_share - target) < 0.02, report[s]
        assert report[s].used_tokens == sum(r.n_tokens * r.copies for r in got if r.fraction == 1.0 and r.source == s)
        assert abs(report[s].deviation - (report[s].reached_share - target)) < 1e-12 and abs(report[s].token_deviation) < 0.02 * sum(r.used_tokens for r in report.values())
    assert report["absent"].used_tokens == 0 and report["absent"].deviation == 0
    # A total that some sources can't fill: they give all they have.
    _, short = mixing.mix(docs, targets, total=10**9)
    assert all(r.most_copies == caps.get(r.source, 0) for r in short.collect())


def test_mixing_of_odd_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    schema = "doc_id bigint, source string, n_tokens bigint"
    documents, shares = mixing.mix(spark.createDataFrame([], schema), targets)
    assert documents.count() == 0 and [r.reached_share for r in shares.collect()] == [0.0]
    documents, _ = mixing.mix(spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, None, 5), (3, "a", None)], schema), targets)
    assert sorted(r.doc_id for r in documents.collect()) == [1, 1]
    documents, _ = mixing.mix(spark.createDataFrame([(1, "a", 5)], schema), targets.where("false"))
    assert documents.count() == 0


def test_token_counts(spark):
    encoding = tokens._encoding(tokens.tokenizer_dir(), tokens.VOCABULARY)
    for text in ("", "a b", "x" + " " * 9000 + "y", "\n" * 5000, " " * 4096 + "\tz", "héllo wörld 123"):
        assert tokens.count_tokens(text, encoding) == len(encoding.encode_ordinary(text))
    rnd = random.Random(12)
    for _ in range(60):  # runs of white space around the length from which they are cut
        pieces = [rnd.choice(["a", "don't", "12", "é", "?!", "\u3000x"]) + rnd.choice([" ", "\n", "\t", "\xa0", " \n"]) * rnd.choice([1, 2, 1365, 2047, 2048, 4095, 4096, 4097, 5000]) for _ in range(rnd.randint(1, 4))]
        text = "".join(pieces) + rnd.choice(["", "end"])
        assert tokens.count_tokens(text, encoding) == len(encoding.encode_ordinary(text)), [p[:4] for p in pieces]
    assert tokens.count_tokens(" " * 2_000_000 + "end", encoding) > 0
    df = spark.createDataFrame([(1, "hello world", 9), (2, None, 9)], "doc_id bigint, text string, n_tokens int").drop("n_tokens")
    assert {(r.doc_id, r.n_tokens) for r in tokens.token_counts(df, ["doc_id"]).collect()} == {(1, 2), (2, 0)}


def letter(body, extra=""):
    return f"From: A <a@b.example>\nSubject: x\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n{extra}\n{body}"


PROSE = "I will look at the report on Monday, and then we can talk about what is missing.\nPlease let me know if that is too late for you and the others."


@pytest.mark.parametrize(
    ("body", "is_prose"),
    [
        (PROSE, True),
        ("Hi all,\n\n" + PROSE + "\n\nBest regards,\nAnna Kern\n-- \nAnna Kern\nTel 1\nTel 2\nTel 3\nTel 4", True),
        ("- red apples\n- green pears\n- plums\n- grapes\n", False),
        ("1. Buy the milk.\n2. Call the bank.\n3. Send the parcel.\n", False),
        ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n", False),
        ("name     qty    price\npears     12     1.50\nplums      7     0.20\n", False),
        ("x;y;z\n1;2;3\n4;5;6\n", False),
        ("a\tb\n1\t2\n3\t4\n", False),
        ("qwxz kjhg plok mnbv zxcv\nasdf lkjh poiu qwer mnbv\n", False),
        ("=" * 30 + "\n" + "=" * 12 + "\n", False),
        ("Here is what we have:\n\nred pallet\nblue crate\nold shelf\nnew gate\n", False),
        ("On Mon, 1 Jan 2024, Bob wrote:\n> - a b\n> - c d\n> - e f\n> - g h\n\n" + PROSE, True),
        (PROSE + "\n\n-----Original Message-----\nFrom: B\nSent: now\n\n| a | b |\n| c | d |\n| e | f |", True),
        ("- a b\n- c d\n- e f\n\nAm 1.1.2024 um 10:00 schrieb Bob B:\n> " + PROSE.replace("\n", "\n> "), False),
        ("Danke, das passt so für mich.", True),
        ("", True),
    ],
)
def test_kinds(body, is_prose):
    assert (quality.measure(letter(body))[-1] == "prose") == is_prose, (mail.own_lines(letter(body)), quality.measure(letter(body)))


def test_parts():
    import base64

    mixed = (
        'Subject: x\nContent-Type: multipart/mixed;\n boundary="b1"\n\npreamble\n--b1\nContent-Type: multipart/alternative; boundary=b2\n\n--b2\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\nGr=C3=BC=C3=9Fe an a=\nlle\n--b2\nContent-Type: text/html\n\n<p>no</p>\n--b2--\n'
        "--b1\nContent-Type: application/pdf\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\nAAAA\n--b1\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode("zwei Zeilen\nhier".encode()).decode() + "\n"
    )
    assert mail.own_lines(mixed) == ["Grüße an alle", "zwei Zeilen", "hier"]
    page = "Content-Type: text/html\n\n<html><head><style>p {}</style></head><body><p>One &amp; two</p><ul><li>a</li><li>b</li></ul><blockquote>old</blockquote></body></html>"
    assert [x for x in mail.own_lines(page) if x.strip()] == ["One & two", "- a", "- b"]
    assert mail.own_lines("no headers here\nat all") == ["no headers here", "at all"]


def test_parts_of_any_depth():
    for depth in (0, 1, 12, 13, 50, 400):
        body = "Content-Type: text/plain\n\nfirst\nsecond"
        for i in range(depth):
            kind = "mixed" if i % 3 else "alternative"
            body = f"Content-Type: multipart/{kind}; boundary=b{i}x\n\n--b{i}x\n{body}\n--b{i}x--\n"
        assert mail.own_lines("Subject: x\n" + body) == ["first", "second"], depth
    # A multipart without its boundary is read as it is; an unending chain of parts keeps its order.
    assert mail.own_lines("Content-Type: multipart/mixed; boundary=zz\n\nno part\nat all") == ["no part", "at all"]
    many = "Content-Type: multipart/mixed; boundary=q\n\n" + "".join(f"--q\nContent-Type: text/plain\n\nline {i}\n" for i in range(50))
    assert mail.own_lines(many) == [f"line {i}" for i in range(50)]


def test_random_strings_with_delimiters_are_junk():
    rnd = random.Random(8)
    body = "\n".join("".join(rnd.choice("qwzxkjvbnm ;") for _ in range(60)) for _ in range(8))
    assert quality.measure(letter(body))[-1] == "junk"
    assert quality.measure(letter("x;y;z\n1;2;3\n4;5;6\n"))[-1] == "table"


def test_quality_of_odd_tables(spark):
    schema = "doc_id bigint, text string, kind string, n_words int"
    rows = [(1, None, "k", 1), (2, "", "k", 1), (2, "", "k", 1), (3, letter("word " * 400_000), "k", 1), (None, letter(PROSE), None, None), (4, "\0\0", "k", 1)]
    got = quality.text_quality(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and sorted((r.doc_id, r.n_words) for r in got if r.doc_id in (1, 2)) == [(1, 0), (2, 0), (2, 0)]
    assert quality.text_quality(spark.createDataFrame([], schema)).count() == 0


def test_agrees_with_labels(spark):
    """The rules look at no label; on the labelled documents they agree with nearly all."""
    from conftest import MIDDLE

    from strandlake.llm.queries import QUERIES

    rows = QUERIES["p8_label_agreement"](spark, MIDDLE).collect()
    right = sum(r.n for r in rows if (r.label == "prose") == (r.kind == "prose"))
    assert right >= 0.95 * sum(r.n for r in rows)
