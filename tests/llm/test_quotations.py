import random
import re

import pytest

from lodestone.llm import quotations as q

SCHEMA = "conv_id long, turn long, role string, text string, position int, hash long"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    return sorted((r for r in q.conversations(df).collect()), key=lambda r: (str(r.conv_id), r.position))


def test_parse_levels():
    text = "Hi\nAnn wrote:\n> first line\n> second\n>> Bob wrote:\n>>> deep\n> back\nmine"
    own, passages = q.parse(text)
    assert own == "Hi\nmine"
    assert passages == [(1, "first line\nsecond"), (3, "deep"), (1, "back")]
    assert q.parse(None) == ("", []) and q.parse("a > b") == ("a > b", [])
    assert q.parse("> only") == ("", [(1, "only")])


def test_links_follow_quotes(spark):
    rows = [
        (1, 0, "user", "Is it  Blue?\nOr red?"),
        (1, 1, "assistant", "Blue."),
        (1, 2, "user", "> is it blue?\nNo, I asked that.\n>> nowhere said"),
        (1, 3, "user", "> Blue.\n>> Is it Blue?\n>> Or red?\nThanks"),
        (2, 0, "user", "> Blue.\nFrom elsewhere"),
        (2, 1, "user", "From elsewhere\n> Or red?"),
        (2, 2, "user", "> From elsewhere\nlast"),
    ]
    got = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    assert (got[1, 2].reply_conv, got[1, 2].reply_turn, got[1, 2].text) == (1, 0, "No, I asked that.")
    assert (got[1, 3].reply_turn, got[1, 3].text) == (1, "Thanks")
    assert [(s.reply_conv, s.reply_turn) for s in got[1, 3].sources] == [(1, 0), (1, 1)]
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn) == (1, 1)
    assert (got[2, 1].reply_conv, got[2, 1].reply_turn) == (1, 0)
    assert (got[2, 2].reply_conv, got[2, 2].reply_turn) == (2, 0)  # the earliest that said it
    assert got[1, 0].reply_turn is None and got[1, 0].sources is None
    assert [r.turn for r in run(spark, rows) if r.conv_id == 1] == [0, 1, 2, 3]
    assert got[1, 1].formatted == "<|assistant|>\nBlue.\n<|end|>\n"


def test_replies_come_after_what_they_quote(spark):
    rows = [(5, t, "user", f"> message {t // 2}\nmessage {t}") for t in range(3000, 0, -1)] + [(5, 0, "user", "message 0")]
    got = run(spark, rows)
    place = {r.turn: r.position for r in got}
    assert sorted(place.values()) == list(range(1, 3002))
    assert all(place[r.turn] > place[r.reply_turn] and r.reply_turn == r.turn // 2 for r in got if r.turn)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (3, 0, "user", "> x"), (3, 0, "user", "> x"), (3, None, "user", "x"), (4, 0, "user", "x " * 60_000)]
    got = run(spark, rows)
    assert len(got) == len(rows) and sorted(r.position for r in got if r.conv_id == 3) == [1, 2, 3]
    assert run(spark, []) == []


def test_quotes_that_the_own_conversation_says_later(spark):
    rows = [
        (1, 0, "user", "> said twice\nsaid twice"),  # itself the smallest conversation that says it, and at the same turn
        (1, 1, "user", "> said later\nhm"),
        (1, 2, "user", "said later"),
        (2, 0, "user", "said twice"),
        (3, 5, "user", "said later\n\nsaid twice"),
        (4, 0, "user", "> said later\nsaid later"),
        (5, 0, "user", "> only here\nonly here"),
    ]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in run(spark, rows)}
    assert got[1, 0] == (2, 0) and got[1, 1] == (3, 5) and got[4, 0] == (1, 2) and got[5, 0] == (None, None)


def brute(rows):
    """{(conv, turn): (sources, reply)} by looking through all messages for each quotation."""
    plain = lambda s: " ".join(s.casefold().split())
    said: dict[str, dict[int, int]] = {}
    for conv, turn, _, text in rows:
        own = q.parse(text)[0]
        for part in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]:
            if plain(part):
                first = said.setdefault(plain(part), {})
                first[conv] = min(turn, first.get(conv, turn))
    links: dict = {}
    for conv, turn, _, text in rows:
        for i, (level, passage) in enumerate(q.parse(text)[1]):
            best = None
            for weight, parts in ((3, [passage]), (2, re.split(r"\n\s*\n", passage)), (1, passage.split("\n"))):
                for part in parts:
                    first = said.get(plain(part), {}) if plain(part) else {}
                    others = sorted((c, t) for c, t in first.items() if c != conv)
                    source = (conv, first[conv]) if first.get(conv, turn) < turn else others[0] if others else None
                    if source and (best is None or (weight, -source[1], -source[0]) > best[0]):
                        best = ((weight, -source[1], -source[0]), source)
            if best:
                links.setdefault((conv, turn), set()).add((level, i, best[1]))
    return {k: (sorted({s for _, _, s in v}), min(v)[2]) for k, v in links.items()}


@pytest.mark.parametrize("seed", range(3))
def test_links_like_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    line = lambda: f"line {rng.randrange(25)}"
    for conv in range(12):
        for turn in range(rng.randint(1, 9)):
            parts = []
            for _ in range(rng.randint(1, 5)):
                parts.append(">" * rng.choice([0, 0, 1, 1, 2, 3]) + " " * rng.randint(0, 1) + rng.choice([line(), line(), ""]))
            rows.append((conv, turn, "user", "\n".join(parts)))
    got = {(r.conv_id, r.turn): ([tuple(s) for s in r.sources], (r.reply_conv, r.reply_turn)) for r in run(spark, rows) if r.sources}
    assert got == brute(rows) and len(got) > 10


def test_a_line_that_all_say(spark):
    rows = [(c, 0, "user", "hello all") for c in range(400)] + [(c, 1, "user", "> hello all\nyes") for c in range(400)]
    got = run(spark, rows)
    assert all((r.reply_conv, r.reply_turn) == (r.conv_id, 0) for r in got if r.turn == 1)


def test_ids_that_are_not_numbers(spark):
    df = spark.createDataFrame([("a", "x", "user", "one"), ("7", "0", "user", "two"), ("7", "1", "user", "> two")], "conv_id string, turn string, role string, text string")
    assert sorted((str(r.conv_id), str(r.reply_turn)) for r in q.conversations(df).collect()) == [("7", "0"), ("7", "None"), ("None", "None")]


def test_many_attributions_in_one_message():
    text = "\n".join(f"A{i} wrote:" for i in range(20_000)) + "\n> q"
    own, passages = q.parse(text)
    assert passages == [(1, "q")] and own.count("wrote:") == 19_999  # only the last is followed by a deeper level
