import random
import re

from tessella.llm import chat

ROWS = [
    (1, 0, "user", "How do I bake bread?\n\nAnd what about cake?", "x"),
    (1, 1, "assistant", "Use flour, water and yeast.", "x"),
    (1, 2, "user", "On Monday, A wrote:\n> And what about\n> cake?\nAnd icing?", "x"),
    (1, 3, "assistant", ">> How do I bake bread?\n> use FLOUR, water and yeast\nHow much water?", "x"),
    (1, 4, "user", "> something that nobody said\nStill here", "x"),
    (1, 5, "user", "> And icing?", "x"),
    (2, 10, "user", "alone", "x"),
    (2, 10, "user", "alone", "x"),
    (2, 9000, "assistant", None, "x"),
    (2, 20000, "user", "> Alone!\r\nyes", "x"),
    (None, 1, "user", "lost", "x"),
    (3, None, "user", "> lost", "x"),
]


def run(spark, rows):
    return chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, branch string"))


def test_quotes_lead_to_replies_and_branches(spark):
    rows = {(r.conv_id, r.turn): r for r in run(spark, ROWS).collect()}
    assert [(rows[1, t].reply_to, rows[1, t].quoted, rows[1, t].branch) for t in range(6)] == [(None, False, 0), (0, False, 0), (0, True, 2), (1, True, 0), (3, False, 0), (2, True, 2)]
    assert rows[1, 2].text == "And icing?" and rows[1, 3].text == "How much water?" and rows[1, 5].text == ""
    assert [(rows[2, t].reply_to, rows[2, t].branch) for t in (10, 9000, 20000)] == [(None, 10), (10, 10), (10, 20000)]
    assert rows[None, 1].reply_to is None and rows[3, None].branch is None
    assert run(spark, ROWS).count() == len(ROWS) and run(spark, []).count() == 0


def test_repeated_rows_and_trimmed_quotes(spark):
    rows = [
        (1, 0, "user", "First matter.\n\nSecond matter\nin two lines.\n\nThird matter.", ""),
        (1, 1, "user", "Another thing.", ""),
        *[(1, 2, "user", "> First matter.\nI agree.", "")] * 3,
        (1, 3, "user", "> First matter.\n>\n> Third matter.\nAgain.", ""),
        (1, 4, "user", "> [...]\n> in two lines.\n> [...]\nOnce more.", ""),
        (1, 5, "user", "in two lines.", ""),
        (1, 6, "user", "> Second matter\n> in two lines.\nThe whole counts first.", ""),
        (1, 7, "user", ">> First matter.\n> Another thing.\n> [...]\nThe least quoted counts.", ""),
    ]
    found = run(spark, rows).collect()
    assert len(found) == len(rows) and {(r.turn, r.reply_to, r.quoted) for r in found} == {(0, None, False), (1, 0, False), (2, 0, True), (3, 0, True), (4, 0, True), (5, 4, False), (6, 0, True), (7, 1, True)}


def test_replies_follow_what_they_reply_to(spark):
    rows = [(7, t, "user", f"message number {t}" + (f"\n> message number {t // 2}" if t % 3 == 0 else ""), "") for t in range(60)]
    order = sorted((r.branch, r.turn, r.reply_to) for r in run(spark, rows).collect())
    seen = set()
    for _, turn, reply in order:
        assert reply is None or reply in seen
        seen.add(turn)


def test_same_rows_as_duckdb(spark):
    import duckdb
    import pandas as pd

    rows = [r[:4] for r in ROWS if r[0] and r[1] is not None][:6]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    want = duckdb.sql(chat.ORACLE).fetchall()
    got = [tuple(r) for r in run(spark, [(*r, "") for r in rows]).select("conv_id", "turn", "role", "text", "reply_to", "quoted", "branch").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def plain(rows):
    """Own text, reply and branch of every turn, message after message."""
    normal = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    paragraphs = lambda t: re.split(r"\n\s*\n", t)
    out, said, first, branches, last = {}, [], {}, {}, None
    for turn, text in sorted(rows):
        lines = re.sub("\r\n?", "\n", text or "").split("\n")
        marks = [re.match(r"[ \t]*(?:>[ \t]*)*", x)[0] for x in lines]
        levels = [m.count(">") for m in marks]
        announced = [bool(re.match(r"(?i)[ \t]*on .*wrote:[ \t]*$", x)) and i + 1 < len(lines) and levels[i + 1] > 0 for i, x in enumerate(lines)]
        own = "\n".join(x for x, n, a in zip(lines, levels, announced, strict=True) if n == 0 and not a).strip()
        best, i = None, 0
        while i < len(lines):
            j = i
            while j < len(lines) and levels[j] == levels[i]:
                j += 1
            if levels[i]:
                body = "\n".join(x[len(m) :] for x, m in zip(lines[i:j], marks[i:j], strict=True))
                for grade, wanted in enumerate(([body], paragraphs(body), body.split("\n"))):
                    for w in filter(None, map(normal, wanted)):
                        for origin, pieces in said:
                            if w in pieces:
                                best = max(filter(None, (best, (-levels[i], -grade, origin))))
            i = j
        reply, quoted = (best[2], True) if best else (last, False)
        carries = reply is not None and reply not in first
        first.setdefault(reply, turn)
        branches[turn] = branches[reply] if carries else turn
        out[turn] = (own, reply, quoted, branches[turn])
        said.append((turn, {normal(p) for p in (own, *paragraphs(own), *own.split("\n"))}))
        last = turn
    return out


def test_quote_rich_conversations_as_by_a_plain_version(spark):
    draw = random.Random(21)
    sentences = [f"{a} {b}" for a in ("Red", "blue", "Über", "old") for b in ("fish.", "door!", "café", "2nd hand", "of")]
    rows = []
    for conv in range(40):
        texts = []
        for turn in range(draw.randint(1, 14)):
            parts = []
            for _ in range(draw.randint(0, 3)):
                if texts and draw.random() < 0.7:
                    source = draw.choice(texts).split("\n")
                    a = draw.randrange(len(source))
                    cut = source[a : a + draw.randint(1, 6)]
                    if draw.random() < 0.3:
                        cut = ["[...]", *cut]
                    if draw.random() < 0.3:
                        parts.append("On Monday, someone wrote:")
                    parts += [draw.choice(["> ", ">", " > "]) + x.upper() if draw.random() < 0.1 else "> " + x for x in cut]
                parts.append("\n".join(draw.choice(["\n\n", "\n"]).join(draw.sample(sentences, draw.randint(1, 3))) for _ in range(draw.randint(0, 2))))
            texts.append(draw.choice(["\n", "\n", "\r\n"]).join(parts))
            rows.append((conv, turn * draw.choice([1, 1, 3]) + 50 * turn, "user", texts[-1] if texts[-1] or draw.random() < 0.5 else None, ""))
    found = {(r.conv_id, r.turn): (r.text, r.reply_to, r.quoted, r.branch) for r in run(spark, rows).collect()}
    want = {(conv, t): v for conv in range(40) for t, v in plain([(r[1], r[3]) for r in rows if r[0] == conv]).items()}
    assert {k: (found[k], want[k]) for k in want if found[k] != want[k]} == {} and sum(v[2] for v in want.values()) > 60


def test_a_message_of_megabytes_with_thousands_of_quoted_lines(spark):
    long = "\n".join(f"line number {k} of a long message" for k in range(40_000))
    quoted = "\n".join(f"> line number {k} of a long message" for k in range(5, 9000))
    rows = [(1, 0, "user", long, ""), (1, 1, "user", "between", ""), (1, 2, "user", f"{quoted}\nagreed", "")]
    found = {r.turn: r for r in run(spark, rows).collect()}
    assert found[2].reply_to == 0 and found[2].quoted and found[2].text == "agreed" and found[0].text == long
