import re
from collections import defaultdict

from tidemill.llm.quotation import link_quotations, op1, parse, units

SCHEMA = "conv_id long, turn long, role string, text string, own string"


def test_parse_levels():
    own, passages = parse("Hi\nOn Monday, X wrote:\n> > deep one\n>> deep two\n> mid\n\nmine\r\n>last")
    assert own == "Hi\n\nmine" and passages == [(2, "deep one\ndeep two"), (1, "mid"), (1, "last")]
    assert parse(None) == ("", []) and parse("  plain > not a quote ") == ("  plain > not a quote ", [])


def brute(rows):
    """{(conv, turn): (parent_turn, linked_words)} for rows of distinct (conv, turn)."""
    parsed = {(c, t): parse(x) for c, t, _, x in rows}
    owns = {k: set(units(p[0])) for k, p in parsed.items()}
    out = {}
    for (c, t), (_, passages) in parsed.items():
        level, words = {}, {}
        for n, p in passages:
            for unit, w in units(p).items():
                level[unit], words[unit] = min(n, level.get(unit, n)), w
        weight = defaultdict(int)
        for unit, w in words.items():
            first = min((u for d, u in owns if d == c and unit in owns[d, u]), default=None)
            if first is not None and first < t:
                weight[level[unit], first] += w
        nearest = min((n for n, _ in weight), default=None)
        best = max(((w, u) for (n, u), w in weight.items() if n == nearest), default=None)
        before = max((u for d, u in parsed if d == c and u < t), default=None)
        out[c, t] = (best[1], best[0]) if best else (before, 0)
    return out


def test_links_against_brute_force(spark):
    says = ["Hello there friend. How are you today?", "I am fine, thanks. And you?", "Let us meet at noon.", "Noon is too early for me.", "Thanks."]
    rows = []
    for c in range(12):
        for t in range(9):
            text = f"{says[(c + t) % 5]} number {t}\n{says[(c * t) % 5]}"
            if t and (c + t) % 3:
                quoted = rows[-1 - (c * t) % t][3] if (c + t) % 2 else rows[-1][3]
                text = "\n".join("> " + line for line in quoted.split("\n")) + "\n" + text
            rows.append((c, t * 300, "user", text))
    out = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame([(*r, None) for r in rows], SCHEMA)).collect()}
    want = brute(rows)
    assert {k: (r.parent_turn, r.linked_words) for k, r in out.items()} == want
    assert any(w for _, w in want.values())
    assert all(r.position == k[1] // 300 for k, r in out.items())
    assert not any(re.search(r"(?m)^>", r.text) for r in out.values())


def test_quotes_of_other_conversations_and_rewrapped_ones(spark):
    rows = [(1, 0, "user", "A sentence that is wrapped anew. Another one.", "x"), (2, 0, "user", "> A sentence that is\n> wrapped anew.\nyes", "x"), (2, 1, "user", None, "x"), (2, 1, "user", None, "x"), (None, 0, "user", "> q\na", None), (3, None, None, "b", None)]
    out = link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == 6 and (by[2, 0].source_conv_id, by[2, 0].source_turn, by[2, 0].parent_turn) == (1, 0, None)
    assert sorted(r.position for r in out if r.conv_id == 2) == [0, 1, 2] and by[2, 1].text == ""
    assert by[None, 0].text == "a" and by[None, 0].position is None and by[3, None].position is None
    assert link_quotations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_covers_the_table(spark, small):
    out = op1(spark, small).collect()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    want = brute(rows)
    assert {(r.conv_id, r.turn): (r.parent_turn, r.linked_words) for r in out} == want and len(out) == len(rows)


def test_nested_quotes_do_not_outweigh_what_is_quoted_directly(spark):
    long = "Shall we meet at noon near the old stone bridge by the river?"
    rows = [(1, 0, "user", long, None), (1, 1, "user", f"> {long}\nNo, later.", None), (1, 2, "user", f"> No, later.\n> > {long}\n\nFine.", None), (1, 3, "user", f">>> {long}\n>> No, later.\n> Fine.\nGood.", None), (1, 4, "user", f"> > {long}\nwhich?", None)]
    out = {r.turn: r for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: r.parent_turn for t, r in out.items()} == {0: None, 1: 0, 2: 1, 3: 2, 4: 0}
    assert {t: r.linked_words for t, r in out.items()} == {0: 0, 1: 13, 2: 2, 3: 1, 4: 13}
    assert {t: (r.parent_turn, r.linked_words) for t, r in out.items()} == {k[1]: v for k, v in brute([r[:4] for r in rows]).items()}


def test_equal_weights_go_to_the_latest_and_very_long_quotes_are_linked(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, 0, "a", "one two.", None), (1, 1, "a", "six ten.", None), (1, 2, "a", "> one two.\n\n> six ten.\nyes", None), (1, 3, "a", long, None), (1, 4, "a", f"> {long}\nseen", None)]
    out = {r.turn: r for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out[2].parent_turn, out[2].linked_words) == (1, 2) and (out[4].parent_turn, out[4].linked_words) == (3, 40_000)


def test_unit_said_later_in_the_own_conversation_is_linked_to_another(spark):
    rows = [(1, 5, "a", "The same sentence here.", None), (1, 0, "a", "> The same sentence here.\nhm", None), (2, 7, "a", "The same sentence here.", None), (3, 0, "a", "The same sentence here.", None)]
    out = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out[1, 0].source_conv_id, out[1, 0].source_turn, out[1, 0].parent_turn) == (2, 7, None)
