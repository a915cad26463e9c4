import pytest

from combline.llm.messages import judge
from combline.llm.residue import residue, segments, slots

#: Wordings looked at while the grammars were written; some are within their reach. Finding them says nothing about unseen ones.
SEEN = [
    "Dear <<customer_name>>, thanks for the honey.", "Hello *|FNAME|*, welcome to the club.", "Harvest date: TBD", "Dear TODO_NAME, your order has left.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium.", "We're sorry, but this site doesn't work properly without JavaScript enabled.",
    "Segmentation fault (core dumped)", "Erreur interne du serveur", "La sesión expiró", "Weight: [WEIGHT_KG] kg", "Hi {first_name}!", "The total is #NAME? today.",
    "Sie haben keine Berechtigung, diese Seite anzuzeigen.", "Lo sentimos, la página que busca no existe.", "Uncaught TypeError: Cannot read property 'x' of undefined", "qwerty asdf zxcv qwer asdf",
    "Your session was terminated. Log in once more.", "Hive %HIVE_NAME% weighed 30 kg.", "Click here to add your subtitle", "xxxx xxxx xxxx xxxx xxxx", "[Insert site description]", "Value of ${siteName} rose.",
    "Bitte hier den Text eingeben", "Ihre Anfrage konnte nicht bearbeitet werden.", "HTTP Error 503. The service is unavailable.", "Neque porro quisquam est qui dolorem ipsum quia dolor",
    "Dear {{ a_very_long_placeholder_name_that_goes_on_and_on_and_on_and_on_and_on_and_on_and_on_and_on_and_on }}, hello.", "Votre navigateur ne prend pas en charge JavaScript.",
    "Gateway did not respond in time. Please try later.", "Poids : undefined kg",
]
CONTENT = [
    "The template has a field {{name}} that the mail script fills.", "My laptop said 'page not found' yesterday, so I called the club.", "We moved the hive. [see photo 3]",
    "He said: \"enable cookies\" and it worked, then the bees flew.", "Null point of the scale was checked; the error was 0.2 kg.", "The bees were calm.", "Honey\nwax\nbees",
    "The **bold** queen *flew* (again) to the oak [2].", "Average weight 30.2 kg, and <b>no</b> brood.", "Error of the scale 0.3 kg\nhoney harvested twelve jars this week\nbees calm",
    "La reina está en el cuadro 7 y pone bien. El sensor dejó de enviar durante 5 horas.", "J'ai compté 4 cadres de couvain et 5 de provisions.", "Die Königin sitzt auf Wabe 3 und legt gut.",
    "Access denied\nThe gate to the yard was locked on Sunday, so I walked along the creek and counted no bees at all.", "We fed 3 litres {two parts sugar, one part water} last night.",
    "The label came back with lorem ipsum on it and I asked for a new one.", "See https://example.org/{id}/page for the map of the yard.",
]

#: Wordings written after the grammars were done, and none of them among 300,000 texts drawn from these. Measured once, without
#: any change after it: 24 of 32 were found, and 1 of 12 content texts was hit. Whoever changes the grammars with these in view needs new ones.
FRESH = [
    'Hello [[recipient.first]], your jars are ready.',
    'Total due: #REF! dollars',
    'Keeper: %%OWNER%%',
    'The hive called ##HIVENAME## swarmed.',
    'Dear [Insert name], thank you.',
    'Nectar flow on {visit_day} was strong.',
    'Humidity: NaN %',
    'Queen age: [object Promise]',
    'Contact: FIXME',
    'Greetings ${user}, see you.',
    'Quo usque tandem abutere Catilina patientia nostra quam diu etiam furor iste tuus nos eludet',
    'Gallia est omnis divisa in partes tres quarum unam incolunt Belgae',
    'hjkl hjkl yuio hjkl yuio',
    'lalala lalala lalala lalala',
    'blubb blubb blubb blubb',
    'Replace me with a real summary',
    'Content for this section is being prepared.',
    'Text folgt in Kürze.',
    'Agregue una descripción aquí',
    'Ajoutez un titre',
    'This account no longer has access to the portal.',
    "Sorry, the document you are looking for isn't here.",
    "We're having trouble reaching the server right now.",
    'Your browser blocked the scripts this page relies on.',
    'Connection reset by peer',
    'Diese Webseite benötigt JavaScript.',
    'Die Verbindung wurde zurückgesetzt.',
    'Ocurrió un problema al cargar el contenido.',
    'Impossible de se connecter au serveur.',
    'java.sql.SQLException: Connection is closed',
    'Proxy authentication is needed to open this address.',
    'HTTP ERROR 418',
]
FRESH_CONTENT = [
    'The server of honey samples at the fair was my aunt.',
    'Our website now lists all hives, and the page for Elm Hill is done.',
    'I lost the connection between the lid and the box.',
    'Error bars on the weight curve are two kilos wide.',
    'She signed in at the gate and looked at the bees.',
    'The script of the play about bees was funny.',
    'Wir haben die Seite des Kastens neu gestrichen.',
    'El enlace entre las dos cajas está firme.',
    'Le service de la reine est terminé, elle pond.',
    'Access to the meadow is by the north road.',
    'Test of the new scale: 30.1 kg, 30.2 kg, 30.1 kg.',
    'In the sheet the tag {hive} is replaced by the macro.',
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, t in enumerate(SEEN + CONTENT)]
    return {r.doc_id for r in residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}


def test_seen_wordings(found):
    missed = [t for i, t in enumerate(SEEN) if i not in found]
    assert len(missed) <= len(SEEN) // 10, missed


def test_content_stays(found):
    hit = [CONTENT[i - len(SEEN)] for i in found if i >= len(SEEN)]
    assert len(hit) <= 1, hit


def test_fresh_wordings(spark):
    df = spark.createDataFrame(list(enumerate(FRESH + FRESH_CONTENT)), "doc_id long, text string")
    got = {r.doc_id for r in residue(df, "doc_id", "text").collect()}
    assert sum(i < len(FRESH) for i in got) >= 24 and sum(i >= len(FRESH) for i in got) <= 1


def test_slots_by_form():
    def inner(t):
        return [t[a:b] for a, b in slots(t)]

    assert inner("a {{x}} b ${y.z} c <%= q %> d [[w]] e <<v>> f %(u)s g @@T@@ h __S__ i {r} j {0} k %Q_R%") == ["{{x}}", "${y.z}", "<%= q %>", "[[w]]", "<<v>>", "%(u)s", "@@T@@", "__S__", "{r}", "{0}", "%Q_R%"]
    assert inner("[12] (mehr) <b>x</b> 50% of 60% {\"a\": 1} **x** *y* a_b_c http://x/{1,2} [see photo]") == []


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (None, "404 Not Found"), (4, "404 Not Found"), (4, "404 Not Found"), (5, " ".join(f"the bees of hive {k} were calm and" for k in range(9_000))), (6, "bees " * 20_000)], "doc_id long, text string").selectExpr("doc_id", "text", "'x' as message", "1 as n", "2 as template")
    assert [(r.doc_id, r.reason) for r in residue(df, "doc_id", "text").orderBy("doc_id").collect()] == [(4, "error"), (6, "residue")]
    assert residue(df.limit(0), "doc_id", "text").collect() == []
    assert segments(df, "doc_id", "text").where("doc_id = 5").count() == 1


def test_verdicts_do_not_depend_on_other_documents(spark):
    notice = "Too many requests. Slow down and try again in 38 seconds."
    many = [(i, f"The scale at site {chr(97 + i % 26)}{i} read {i} kg before noon.") for i in range(300)]
    for extra in ([], many):
        df = spark.createDataFrame([(9000, notice), (9001, "The bees were calm."), *extra], "doc_id long, text string")
        assert {r.doc_id for r in residue(df, "doc_id", "text").collect()} == {9000}


def test_what_may_be_a_slot_needs_values_in_its_place(spark):
    rows = [(i, f"Keeper of hive number {i} in the valley is {n} since spring.") for i, n in enumerate(["Anna", "Boris", "Clara", "HIVE_OWNER", "Dora", "Emil"])]
    rows.append((50, "The constant MAX_SIZE is nine."))
    assert {r.doc_id for r in residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()} == {3}


def test_classifier_on_other_draws_of_its_grammars():
    from combline.llm.phrases import examples

    by = judge()
    held = examples(1_500, seed=991)
    right = sum(max(by.kind(t), key=by.kind(t).get) == c for t, c in held)
    assert right / len(held) >= 0.9
