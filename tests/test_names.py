from pyspark.sql import functions as F

from sentrymill.functions import names as NM
from sentrymill.functions import text as T
from sentrymill.operators.extract import event_anchor, with_place
from sentrymill.operators.victim import victim_name


def one(rows, values, fn):
    """Results of a column function over values, in order."""
    got = rows(list(enumerate(values)), "i int, v string", "i", fn(F.col("v")))
    return [v for _, v in sorted(got, key=lambda r: r[0])]


def test_victims_of_known_headlines(rows):
    cases = {
        "Study app Canvas and its parent firm Instructure.": "Instructure",
        "Russia Hacked Routers": None,
        "Schulte-Lindhorst GmbH & Co. was hit by ransomware attack": "Schulte-Lindhorst GmbH & Co.",
        "TanStack Supply Chain Attack Hits Two OpenAI Employee Devices": "TanStack",
        "Medtech giant Stryker fully operational after data-wiping attack": "Stryker",
        "Trellix source code breach claimed by RansomHouse": "Trellix",
        "Acme confirms breach affecting Russian users": "Acme",
        "OpenAI confirms Mixpanel data breach": "Mixpanel",
        "Škoda confirms breach": "Škoda",
        "Webinar: how Acme was breached": None,
        "Hackers confirmed a breach": None,
    }
    got = one(rows, list(cases), lambda c: victim_name(c, F.lit(""), F.lit(""), F.lit(False)))
    assert dict(zip(cases, got)) == cases


def test_alert_feeds_only_use_the_body(rows):
    out = rows([("Acme was breached", "Widget is developed by Initech")], "t string, b string",
               victim_name(F.col("t"), F.lit(""), F.col("b"), F.lit(True)), victim_name(F.col("t"), F.lit(""), F.lit(""), F.lit(True)))
    assert out == [("Initech", None)]


def test_name_cleaning(rows):
    cases = {"DoD. The attack was": "DoD", "U.S. Navy": "U.S. Navy", "Foo & Co.": "Foo & Co.", "cybersecurity firm": None,
             "Popular Bank": "Popular Bank", " the Acme, ": "Acme", "crypto exchange Bybit": "Bybit", "": None, "ab": None,
             "Acme on Friday": "Acme", "Fake Acme": None, "Executive Summary: x": None}
    assert dict(zip(cases, one(rows, list(cases), NM.clean_org))) == cases


def test_generic_descriptors_keys_and_acronyms(rows):
    assert one(rows, ["cybersecurity firm", "Popular Bank", "bank", "First National Big Bank", None], NM.generic_descriptor) == [
        True, False, True, False, False]
    assert one(rows, ["Acme, Inc.", "A&B Co", "Solutions", None, "Über-Org's"], NM.org_key) == [
        "acme", "a and b", None, None, "ber org"]
    assert one(rows, ["National Health (NHS)", "IBM group", "AB CD", "Acme"], NM.org_acronym) == ["NHS", "IBM", None, None]


def test_vendors_and_company_case(rows):
    cases = {"ABB Ability Symphony Plus Engineering": "ABB", "Johnson Controls CEM AC2000": "Johnson Controls",
             "Apple Multiple Products Buffer Overflow": "Apple", "BeyondTrust Remote Support": "BeyondTrust"}
    assert dict(zip(cases, one(rows, list(cases), NM.advisory_vendor))) == cases
    cased = {"AT&T": "AT&T", "8-K": "8-K", "IBM": "IBM", "EQUIFAX": "Equifax", "inc": "Inc", "GMBH": "GMBH", "MixedCase": "MixedCase"}
    assert dict(zip(cased, one(rows, list(cased), T.company_case))) == cased


def test_sentences(rows):
    cases = {"Mr. Smith went. The U.S. Navy said no": "Mr. Smith went.", "Hello world (ok). And then [...]": "Hello world (ok).",
             "The firm Inc. Said so": None, "no end": None, "Done.": "Done.", "Wait... what …": None, "A b!  C d": "A b!", None: None}
    assert dict(zip(cases, one(rows, list(cases), T.clean_summary))) == cases


def test_markup(rows):
    cases = {"a &lt;b&gt;bold&lt;/b&gt;": "a bold", "x&nbsp;&eacute;&#33;": "x é!", "<p> one\n two </p>": "one two", None: ""}
    assert dict(zip(cases, one(rows, list(cases), T.clean_html))) == cases


def test_places(spark):
    def place(text, lead=None):
        frame = spark.createDataFrame([(text.lower(), (lead if lead is not None else text).lower())], "text_all string, text_lead string")
        got = with_place(frame, "p").select("p.country", "p.region").first()
        return tuple(got)
    assert place("attacks on hospitals in Kenya", "") == ("Kenya", "Africa")
    assert place("West Pharma is a publicly traded American manufacturing company", "") == ("United States", "North America")
    assert place("LockBit is a Russian ransomware firm", "") == (None, None)
    # Terms are substrings, so quirks stay.
    assert place("thousand things") == ("United States", "North America")
    assert place("the ukraine") == ("United Kingdom", "Europe")
    assert place("breach affecting Russian users") == (None, None)
    assert place("a wave across europe") == (None, "Europe")


def test_anchors(rows):
    def anchor(title, source="x"):
        a = rows([(title, source)], "t string, s string", event_anchor(F.col("t"), F.lit(""), F.lit(None).cast("string"), F.col("s")))
        return tuple(a[0][0])
    assert anchor("Acme Widget flaw (cve-2024-12)") == ("CVE-2024-12", "vulnerability")
    assert anchor("Black Storm hits banks") == ("Black Storm", "campaign")
    assert anchor("ABB Controller", "cisa-alerts-advisories") == ("ABB Controller", "product_or_platform")
    assert anchor("Serious bug in Acme Mail, now") == ("Acme Mail", "product_or_platform")
    assert anchor("Nothing here") == (None, "unknown")


def test_disclosures(rows):
    body = "Item 1.05 Material Cybersecurity Incidents. " + "On May 1 the company found an intrusion into its systems and contained it quickly. " * 2 + "SIGNATURES"
    got = one(rows, [f"<p>{body}</p>", "short", "No match. " * 5 + "A cyber event hit us. " + "More text follows here. " * 8, None], T.disclosure_excerpt)
    assert got[0].startswith("On May 1") and not got[0].endswith("SIGNATURES")
    assert got[1] is None and got[3] is None
    assert got[2].startswith("A cyber event hit us. More text")
    long = "First sentence is here. " * 40
    summary = one(rows, [long, "x" * 500 + ". Next."], T.opening_summary)
    assert len(summary[0]) <= 400 and summary[0].endswith(".") and summary[1] == "x" * 500 + "."
