"""Word lists of the detection policy."""

from __future__ import annotations

from dataclasses import dataclass

# The lists below decide which names are kept and must be as they are.

INSTITUTIONS = tuple(
    """sebi|securities and exchange board of india|rbi|reserve bank of india|roc|registrar of companies|ministry of corporate affairs|mca
government of india|ministry of commerce and industry|department of commerce|directorate general of foreign trade|dgft|income tax department
central board of direct taxes|cbdt|gst council|irdai|competition commission of india|nclt|nclat|supreme court|high court|state government
maharashtra state government|central processing centre|regional director|bse|nse|bse limited|national stock exchange
national stock exchange of india limited|stock exchanges|nsdl|cdsl|national securities depository limited|central depository services
clearing corporation|nse clearing limited|indian clearing corporation limited|companies act|companies act, 2013|companies act, 1956
sebi icdr regulations|icdr regulations|sebi listing regulations|sebi lodr regulations|securities contracts|scra|sccr|fema
foreign exchange management act|income tax act|ind as|indian accounting standards|gaap|ifrs|insolvency and bankruptcy code
prevention of money laundering act|sebi merchant bankers regulations|sebi mutual funds regulations|sebi fpi regulations|sebi aif regulations
sebi vcf regulations|sebi sbeb regulations|sebi insider trading regulations|sebi takeover regulations|maharashtra industrial policy
meis|rodtep|gst|upi|asba|npci|national payments corporation of india|fbil|crisil|icra|care ratings|india ratings|our company|the company
our board|the board|our promoters|the promoters|our group companies|board of directors|audit committee
nomination and remuneration committee|stakeholders relationship committee|risk management committee|corporate social responsibility committee
csr committee|book running lead managers|brlms|syndicate members|anchor investors|qualified institutional buyers|qibs
non-institutional investors|retail individual investors|eligible employees|selling shareholders|underwriters""".replace("\n", "|").split("|")
)

PERSON_STOPWORDS = tuple(
    """chairman|director|managing director|joint managing director|executive director|independent director|whole-time director
whole time director|company secretary|compliance officer|chief financial officer|chief executive officer|promoter|promoters|shareholder
shareholders|auditor|auditors|statutory auditor|peer review|contact person|investor|mr|mrs|ms|dr|shri|smt|sir|madam|limited
private limited|llp|trust|fiscal|fiscals|equity shares|equity share|offer|bid|allotment|rupees|lakh|crore|million|billion""".replace("\n", "|").split("|")
)

MARKERS = tuple(
    "act|regulations|rules|guidelines|policy|scheme|circular|notification|tribunal|court|ministry|department|commission|authority|board of india|stock exchange|depository|government".split("|")
)

STRONG_FORMS = tuple("limited ltd llp inc incorporated corporation corp gmbh plc ab nv spa huf trust".split())

WEAK_FORMS = tuple(
    "co company associates consultants partners partnership firm ventures holdings industries enterprises technologies solutions securities systems works mills sons brothers group".split()
)

GENERIC_EXTRA = tuple("the of and private public family our its".split())

KEPT_SITES = tuple("sebi.gov.in bseindia nseindia rbi.org.in mca.gov.in fbil.org.in nsdl cdsl oanda.com npci".split())

#: A core of document vocabulary that is never part of a name; a corpus brings its own list as a parameter.
CORE_NOISE = tuple(
    """bid bids bidder bidders offer price amount allotment issue issuer anchor escrow cap floor syndicate prospectus share shares equity
capital shareholder promoter promoters securities account accounts bank broker depository registrar mutual fund funds investor investors
key managerial personnel committee meeting auditor auditors audit report statement financial fiscal schedule material tower building road
street nagar society village district industrial estate park office website notice registered iso standard reference rate gram jyoti yojana""".split()
)

# End of the fixed values.


@dataclass(frozen=True)
class Lexicon:
    institutions: tuple[str, ...] = INSTITUTIONS
    person_stopwords: tuple[str, ...] = PERSON_STOPWORDS
    markers: tuple[str, ...] = MARKERS
    strong: tuple[str, ...] = STRONG_FORMS
    weak: tuple[str, ...] = WEAK_FORMS
    noise: tuple[str, ...] = CORE_NOISE
    kept_sites: tuple[str, ...] = KEPT_SITES
    #: True: institutional markers count as whole words only, not inside others ("act" in "manufacturing").
    whole_word_markers: bool = False

    @property
    def generic(self) -> tuple[str, ...]:
        return (*self.strong, *self.weak, *GENERIC_EXTRA)
