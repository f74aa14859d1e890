import json
import random

import numpy as np
from pyspark.sql import functions as F

from idloom.llm.email import Mail, ancestors, bodies, message_links, own_lines, own_text_lines
from idloom.llm.trees import fit

PARENT = "Hello Ann,\n\nthe numbers of the second quarter look wrong to me and I wonder why.\nPlease have a look before Friday, the board meets then.\n\nBest,\nBob"


def own(body, ancestor=None, sender=None):
    m = Mail(body, ancestor, sender)
    return own_lines(m, m.label())


def test_marked_quotes_and_signature():
    b = "Hi Bob,\n\nI will check it today.\n\nBest regards,\nAnn Lee\nAnalyst\n\nOn Mon, Jan 02, 2023 at 03:23 PM, Bob\n<bob@x.test> wrote:\n> Hello Ann,\n>\n> the numbers"
    assert own(b, None, "Ann Lee") == [1, 3]


def test_answers_between_and_below():
    b = "On 2023-01-02 10:00, Bob wrote:\n> first question\n> goes on\n\nYes, that is right for us.\n\n> second question\n> goes on\n\nNo, not before the end of May.\n\n-- \nAnn"
    assert own(b) == [5, 10]


def test_unmarked_history_needs_the_ancestor():
    b = "Bob writes:\n" + PARENT.replace("Friday, the board", "Friday,\nthe board") + "\n\nThat was my mistake, the sheet had an old rate in it."
    lines = b.split("\n")
    assert own(b, PARENT) == [len(lines)]


def test_remnants_of_earlier_mails():
    b = "> Jo asked again\n> last week, before the\nthe numbers of the second quarter look wrong\n> to me and I wonder why.\n\nYes, the sheet had an old rate in it."
    m = Mail(b, None, None, None, [PARENT])
    assert own_lines(m, m.label()) == own(b) == [6]
    # A line that starts anew below a finished quote is told by the ancestor alone.
    b = "> Jo asked again\n> last week.\n\nThe numbers of the second quarter look wrong to me and I wonder why.\n\n> Is it\n> right?\n\nYes, the sheet had an old rate in it."
    m = Mail(b, None, None, None, [PARENT])
    assert own_lines(m, m.label()) == [9] and own(b) == [4, 9]
    # Before anything is quoted, a line like one of theirs is alike by chance.
    b = "the numbers of the second quarter look wrong\nin the sheet that you sent today.\n\nBob writes:\n> Hello"
    m = Mail(b, None, None, None, [PARENT])
    assert own_lines(m, m.label()) == [1, 2]
    # The mail answered is not known here, so the text below its attribution stays history.
    b = "Bob writes:\nanother mail that nobody kept, with a long line of words.\n\nRegards,\nBob"
    m = Mail(b, None, None, None, [PARENT])
    assert own_lines(m, m.label()) == own(b) == []


def test_lines_that_broke_off_a_quote():
    b = "> the growth squad noticed\nstale rows in it\n> on Tuesday. Please\nhave a look.\n\nYes, it was so.\n> and after that\n\nThe reload is done.\n> Jo asked again.\nNo, not yet.\n> Right?"
    assert own(b) == [6, 9, 11]
    assert own("> it was on\n> Monday.\nAnn from the desk\n> called twice.\n\nI will see.") == [6]


def test_footers_are_told_by_recurrence():
    from idloom.llm.email import line_key

    foot = "Our pigeons carry mail on working days only."
    freq = {line_key(foot): (0.1, 3.0, 1.0), line_key("The export is done now."): (0.1, 3.0, 0.2)}
    b = f"Hi Bob,\n\nThe export is done now.\n\nBest,\nAnn\n\n{foot}"
    m = Mail(b, None, "Ann", freq)
    assert own_lines(m, m.label()) == [1, 3]
    # Above a closing the same words are the sender's own, and so are unknown ones.
    m = Mail(f"Hi Bob,\n\n{foot}\n\nBest,\nAnn", None, "Ann", freq)
    assert own_lines(m, m.label()) == [1, 3]


def test_frequencies_count_lines_of_any_length(spark):
    from idloom.llm.email import frequencies, line_key

    long = "x" * 5000
    rows = [(i, f"s{i % 2}", f"Hallo {i}\n{long}\n\nGrüße\n Foot LINE\n> quoted\nafter") for i in range(4)] + [(9, None, ""), (10, "s0", "Foot line\n\nText")]
    got = {r._mid: r.lines for r in frequencies(spark.createDataFrame(rows, "_mid bigint, sender string, body string")).collect()}
    assert set(got) == {0, 1, 2, 3, 10}
    assert got[0][line_key(long)].asDict() == {"f": 2 / 3, "c": np.log1p(4), "t": 0.0} and line_key("after") not in got[0]
    assert got[0][line_key("Foot line")].t == 0.8 and line_key("Grüße") in got[1]


def test_all_referenced_mails_are_ancestors(spark):
    def row(i, **headers):
        return i, json.dumps({"headers": [{"name": k.replace("_", "-"), "value": v} for k, v in {"message_id": f"<{i}@x>", **headers}.items()]})

    msgs = [row(1), row(2, in_reply_to="<1@x>"), row(3, in_reply_to="<9@x>", references="<1@x>\r\n <2@x> <9@x> <3@x>"), row(3, references="<1@x>"), row(4, references="<1@x> <2@x>")]
    rows = [(i, json.dumps({"message_id_header": f"<{i}@x>", "body_plain": f"body {i}"})) for i in range(1, 5)]
    b, m = (spark.createDataFrame(x, "_row_id bigint, _raw_record string") for x in (rows, msgs))
    mails = bodies(b).withColumn("_mid", F.col("_row_id")).join(message_links(m), "message_id", "left")
    got = {r._mid: (r.ancestor, r.others) for r in ancestors(mails).collect()}
    assert got == {2: ("body 1", []), 3: (None, ["body 1", "body 2"]), 4: ("body 2", ["body 1"])}


def test_forward_and_notice_and_postscript():
    b = "FYI, see below.\n\nThanks,\nAnn\n\nP.S. Call me before you answer them, please.\n\n----- Original message -----\nFrom: Bob <bob@x.test>\nSent: 2023-01-02\nSubject: x\n\nHello"
    assert own(b) == [1, 6]
    assert own("Done as you asked.\n\nThis message and its attachments are meant only for the named addressee and may hold\nprotected material.") == [1]


def test_decoys_stay():
    b = "As Jo wrote: the ledger is final.\nFrom: the staging set, to: the live set, nothing moved.\nOn Feb 03, 2023 Jo wrote a longer note, I attach it.\n\n> 49% of the rows is what we saw.\n\n* 12 invoices are open\n____ is the placeholder used."
    assert own(b) == [1, 2, 3, 5, 7, 8]


def test_long_and_empty_bodies():
    assert own("") == [] and own("\n\n \r\n") == []
    assert len(own("word " * 200_000)) == 1
    assert own("> " * 50_000 + "x") in ([], [1])


def test_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = fit(x[:3000], y[:3000])
    assert ((t.score(x[3000:]) > 0) == y[3000:]).mean() > 0.97
    assert (fit(x, np.ones(len(x))).score(x) > 0).all() and len(fit(np.zeros((0, 6)), np.zeros(0)).score(x)) == len(x)


def test_held_out_agreement_and_dirt(spark):
    rnd = random.Random(7)
    msgs, rows = [], []
    for i in range(120):
        mine = f"Dear team,\n\nthe {' '.join(rnd.choices('report ledger export is was ready for old new review of sales in week plan'.split(), k=14))} {i}.\n\nBest,\nAnn"
        body = mine + f"\n\nOn 2023-01-02 10:00, Bob wrote:\n> please send number {i}\n> soon" if i % 2 else mine
        rows.append((i, json.dumps({"message_id_header": f"<{i}@x>", "body_plain": body})))
        msgs.append((i, json.dumps({"id": str(i), "headers": [{"name": "Message-ID", "value": f"<{i}@x>"}, {"name": "From", "value": "Ann <ann@x.test>"}, {"name": "In-Reply-To", "value": "<0@x>"}]})))
    rows += [(900, None), (901, "{"), (902, '{"body_plain": null}'), (903, '{"body_text_from_html": "hello there", "message_id_header": null}'), (904, json.dumps(rows[0][1])), (5, rows[5][1])]
    b = spark.createDataFrame([(*r, "clash") for r in rows], "_row_id bigint, _raw_record string, body string")
    m = spark.createDataFrame(msgs + [(7, None), (8, "[]")], "_row_id bigint, _raw_record string")
    got = {}
    for r in own_text_lines(b, m).collect():
        got.setdefault(r._row_id, []).append(r.line_no)
    assert all(sorted(got[i]) == [1, 3] for i in range(120) if i != 5)
    assert sorted(got[5]) == [1, 1, 3, 3] and got[903] == [1] and 900 not in got and 901 not in got
    assert own_text_lines(b.limit(0), m.limit(0)).count() == 0


def test_held_out_blocks_agree_with_the_rules():
    """Trees fitted on one half of varied mails give the other half's labels."""
    from idloom.llm.email import FEATURES

    rnd = random.Random(11)
    words = "report ledger export is was ready for old new review of sales in week plan the desk asked about numbers again".split()
    say = lambda n: " ".join(rnd.choices(words, k=n)).capitalize() + "."

    def mail():
        parts = [rnd.choice(["Hi Bob,", "Dear team,", "Hallo Ann,"]), *[say(rnd.randint(6, 20)) for _ in range(rnd.randint(1, 3))]]
        parent = f"Hello Ann,\n\n{say(14)}\n{say(12)}\n\nBest,\nBob"
        if rnd.random() < 0.6:
            parts.append(rnd.choice(["Best regards,\nAnn Lee", "Cheers,\nAnn", "-- \nAnn Lee\n+1 555 0100 200", "Sent from my phone"]))
        if rnd.random() < 0.3:
            parts.append("P.S. " + say(9))
        if rnd.random() < 0.3:
            parts.append("This message is confidential information meant only for the named addressee.")
        known = rnd.random() < 0.6
        kind = rnd.randrange(4)
        if kind == 0:
            parts.append("On 2023-01-02 10:00, Bob wrote:\n" + "\n".join("> " + x for x in parent.split("\n")))
        elif kind == 1:
            parts.append("----- Original message -----\nFrom: Bob <bob@x.test>\nSent: 2023-01-02\nSubject: x\n\n" + parent)
        elif kind == 2:
            parts.append("Bob writes:\n" + parent + ("\n\n" + say(12) if known else ""))
        return Mail("\n\n".join(parts), parent if known and kind < 3 else None, "Ann Lee")

    mails = [mail() for _ in range(600)]
    half = mails[:300]
    model = fit(np.concatenate([m.features() for m in half]), np.concatenate([m.label() for m in half]), depth=6, bins=64)
    rest = mails[300:]
    x, y = np.concatenate([m.features() for m in rest]), np.concatenate([m.label() for m in rest])
    assert x.shape[1] == len(FEATURES) and ((model.score(x) > 0) == (y > 0)).mean() > 0.99 and 0.2 < y.mean() < 0.8


def test_lines_below_quotes_count(spark):
    from idloom.llm.email import _mails, frequencies, line_key, prepared

    foot = "Our pigeons carry mail on working days only."
    asked = "> Hello Ann,\n> is number {0} right?\n"
    below = "On 2023-01-02 10:00, Bob wrote:\n" + asked + "\nYes, number {0} is right for us.\n\nBest,\nAnn\n\n" + foot
    between = asked + "\nThat one is done.\n\n> and {0}?\n> soon?\n\nNot before May {0}.\n\nBest,\nAnn\n\n" + foot
    texts = [t.format(i) for i in range(2) for t in (below, between)]
    f = {r._mid: r.lines for r in frequencies(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "_mid bigint, sender string, body string")).collect()}
    assert all(f[i][line_key(foot)].asDict() == {"f": 1.0, "c": np.log1p(4), "t": 1.0} and f[i][line_key("Best,")].t == 0.0 for i in range(4))
    assert all(line_key(x) not in f[i] for x in ("> Hello Ann,", "On 2023-01-02 10:00, Bob wrote:") for i in range(4))
    rows = [(i, json.dumps({"message_id_header": f"<{i}@x>", "body_plain": t})) for i, t in enumerate(texts)]
    b, m = spark.createDataFrame(rows, "_row_id bigint, _raw_record string"), spark.createDataFrame([], "_row_id bigint, _raw_record string")
    t = prepared(b, m).df.orderBy("_row_id").toArrow()
    assert [own_lines(x, x.label()) for x in _mails(t)] == [[5], [4, 9]] * 2


def test_unmarked_history_does_not_count_again():
    from idloom.llm.email import line_key, said_lines

    def said(body, ancestor=None, others=()):
        m = Mail(body, ancestor, None, None, list(others))
        return {x.no: t for x in m.lines if x.text and not x.depth and (t := said_lines(m.lines, m.compared).get(line_key(x.raw))) is not None}

    foot = "Our pigeons carry mail on working days only."
    answer = f"Hello Ann,\n\nthat was my mistake, the sheet had an old rate in it.\n\nBest,\nAnn\n\n{foot}"
    parent = PARENT + "\n\nOne more thing: the old sheet is in the archive now."
    # Of the lines below an attribution without marks those of the mail answered are left out; closings go with the text above.
    n = len(parent.split("\n")) + 3
    got = said(f"Bob writes:\n{parent}\n\n{answer}", parent)
    assert min(got.values()) == 0 and got[n + 2] == got[n + 4] == 0 and got[n + 7] == 1
    assert not {line_key(x) for x in parent.split("\n") if len(x.split()) >= 5} & set(said_lines((m := Mail(f"Bob writes:\n{parent}\n\n{answer}", parent)).lines, m.compared))
    # Where no earlier mail is known every line counts.
    assert len(said(f"Bob writes:\n{parent}\n\n{answer}")) > len(got)
    # Below a forward's header block and within an indented quote it is another mail's text; a line like a header is none.
    assert list(said("From: the staging set, to: the live set.\n\nDone.\n\n----- Original message -----\nFrom: Bob <bob@x.test>\nSent: 2023-01-02\n\nHello")) == [1, 3]
    assert list(said("Yes.\n\nBob writes:\n\n    One more thing: it is done.\n    Best,\n\nRight.")) == [1, 8]
    assert said("Best,\nAnn\n\nBest,\n> x\n> y\n\nAnn") == {1: 0, 2: 1, 4: 0, 8: 1}
