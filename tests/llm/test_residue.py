import pytest

from idloom.llm.residue import evidence, read, residue, without_residue

FOUND = [
    "Hi {{ city }},", "The open amount is undefined.", "We booked the call for XX/XX/XXXX.", "Dear [object Object], thank you.", "Welcome to *|COMPANY|*!", "Best,\n<%= owner %>", "Some text first.\nHola &lt;Your Title&gt;:", "Hallo [Vorname],",
    "404 Not Found\nnginx", '{"error": {"code": 503, "message": "Gateway time-out", "request": "aa11bb22"}}', "<html><body>Página no encontrada<br>Menu</body></html>", "このページを表示するにはJavaScriptを有効にしてください。", "Please enable JavaScript to view this page.\nMenu\nLog in",
    "Lorem ipsum dolor sit amet consectetur. Elit sed do eiusmod tempor.", "TBD", "Text to follow\nHeadline goes here", "%s 様",
]
KEPT = [
    "In the model we write {{first_name}} and the compiler puts the table name there.", "The sync answered 503 twice last night, then it worked.", "People who switch JavaScript off are not counted in the report.", "Write to [Lisna Droselmo] with the details.",
    "The designer asked us to swap the lorem ipsum block on the tour page for the copy below.", "Set the rate to 20% {approx.} and the label to [internal].", "[11:01] Ann: we agreed on the plan for the next month.", "seat_count: null\nplan_id: string", "Thanks,\nAnn", "Menu\nLog in",
    "KÃ¼mmert sich vor dem Fest um das Netz", "",
]


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    p, f, *_ = read(text, None)
    assert p or f


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    p, f, *_ = read(text, None)
    assert not (p or f)


ONE_LINE = [
    "Hi [INSERT DUE_DATE], - The warehouse crew wants the calendar feed to run shortly after the release, not at midnight.", "Hi <<Insert amount>>, Zanrik Oskerly and Jornor checked the sync job together at the end of the quarter.",
    "{{ due_date }} Thistlegate Labs reported two merged accounts in the merge log this afternoon.", "Bonjour [object Object], Selon Arynor, des pages tardives ne posent plus problème.",
    "Hi undefined, After 3 runs the revenue measure still shows a second billing contact (see the list).", "undefined Marketing approved the invoice run right after lunch and found an empty referrer in it.",
    "We will charge the amount of {{ amount }} to the card on file on the first day of the next month.", "The amount still open for the plan that your team ordered in March is undefined.",
    "See you on Monday.\nBest,\nundefined", "Hi {{ name }}, In the model we write the table name and the compiler puts it there.",
]
LONG_PROSE = [
    "A mail with {{first_name}} left in it reached Lanternstead Labs at the end of the quarter; our data team has fixed the source and sent a new one.", "None of the rows that we looked at this morning had the wrong price in the list.",
    "The undefined behaviour of the sync job was seen in all three runs of this week.", "Where the owner field of a row is null, the sync goes on with the row that comes next.",
]


@pytest.mark.parametrize("text", ONE_LINE)
def test_slots_of_long_sentences(text):
    assert read(text, None)[0]


@pytest.mark.parametrize("text", LONG_PROSE)
def test_long_prose_about_slots(text):
    assert not read(text, None)[0]


def test_weak_evidence_needs_hosts_and_dirt(spark):
    weak = "Maintenance: browser support is being changed right now here"
    rows = [(i, weak, "a title about quite other things", f"org{i}") for i in range(4)] + [(10, weak.replace("browser", "error browser"), "t", None), (20, None, None, None), (21, "  ", "t", "o"), (22, "fine text about the plan of the year", None, None), (23, "Hi {{x}},", None, None), (23, "Hi {{x}},", None, None), (24, "y" * 500_000, None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, title string, organization_id string, host string")
    got = sorted(r.doc_id for r in residue(df, "doc_id", "text", "title", "organization_id").collect())
    assert got == [0, 1, 2, 3, 23, 23]
    assert without_residue(df, "doc_id", "text", "title", "organization_id").count() == len(rows) - len(got)
    assert residue(df.limit(0), "doc_id", "text", "title", "organization_id").count() == 0


def test_repeated_responses_need_no_listed_word(spark):
    english = "Our crew is giving this place a fresh coat of paint. Ticket {}"
    spanish = "Estamos renovando esta sección para servirle mejor"
    japanese = "ただいま準備中のためしばらくお待ちください"
    rows = [(100 + i, english.format(f"ab12cd{i}{i}"), "quarterly revenue by region", f"org{i}") for i in range(6)]
    rows += [(200 + i, spanish, "informe trimestral", f"org{i}") for i in range(5)] + [(300 + i, japanese, "月次報告", f"org{i}") for i in range(5)]
    rows += [(400 + i, "Gone fishing", "quarterly revenue by region", f"org{i}") for i in range(3)] + [(450 + i, "El servidor está en mantenimiento desde hoy", "informe trimestral", f"org{i}") for i in range(3)]
    # Too few hosts; one host; the titles' own text; different numbers.
    rows += [(500 + i, "We moved the ledger to the new office today", "other terms entirely", f"org{i}") for i in range(4)]
    rows += [(600 + i, "The kitchen is closed on every Monday of May", "other terms entirely", "org0") for i in range(9)]
    rows += [(700 + i, "The summer menu of the kitchen starts today", "other terms entirely" if i else "summer menu of the kitchen", f"org{i}") for i in range(6)]
    rows += [(800 + i, f"After {i} runs the feed still shows double rows", "other terms entirely", f"org{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, title string, organization_id string")
    got = sorted(r.doc_id for r in residue(df, "doc_id", "text", "title", "organization_id").collect())
    assert got == [*range(100, 106), *range(200, 205), *range(300, 305), *range(400, 403), *range(450, 453)]


def test_titles_and_hosts_decide_over_known_forms(spark):
    """A known form alone decides nothing; the title's terms, duplication over hosts and company do."""
    rows = [(1, "Request blocked", "Request blocked", "a"), (2, "Request blocked today", "blocked request today", "a")]
    rows += [(3, "Access denied", "Access denied", "a"), *[(10 + i, "Access denied", "the plan of the year", f"org{i}") for i in range(20)]]
    # Unlisted sentences beside known forms at several hosts are of their kind, also where they then stand alone.
    rows += [(100 + i, "Bad Gateway\nOur pigeons are looking into it right now.", "quarterly revenue by region", f"org{i}") for i in range(4)]
    rows += [(110, "Our pigeons are looking into it right now.", "quarterly revenue by region", "org9"), (111, "Our pigeons are looking into it right now.\nWe counted all of the orders of last week by hand.", "quarterly revenue by region", "org9")]
    # A report that quotes an error message beside sentences of its own.
    rows += [(120, "Bad Gateway\nThat is what the sync job said twice, so we moved it to another hour.", "other terms entirely", "org1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, title string, organization_id string")
    got = {r._id: r.reason for r in evidence(df, "doc_id", "text", "title", "organization_id").collect()}
    assert set(got) == {3, *range(10, 30), *range(100, 104), 110}
    assert got[3] == "hosts" and got[10] == "mismatch and hosts" and got[100] == "hosts" and got[110] == "hosts"
