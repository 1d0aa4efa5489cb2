"""Labelled sentences from which the field for personal information is trained.

Written for this purpose, and extended where the field erred. A sentence is a frame with slots; `sentences()` fills them, and the filled text of a slot in
capitals is a labelled piece. Lower-case slots and those in braces are ordinary text. Names are drawn half from
common names and half from invented syllables, so that the field learns where names stand and not which there are.
For measuring, every fifth frame can be held out.
"""

from __future__ import annotations

import random
import re

from millrace.llm import labelled_pages

# fixed texts: common given names, and endings of family names
GIVEN = "James Mary Robert Patricia Michael Jennifer David Linda Carlos Maria Ahmed Fatima Wei Ling Olga Ivan Pierre Claire Hans Greta Kofi Amara Luis Carmen Diego Lucia Aiko Kenji Priya Arjun Nadia Omar Ingrid Lars Chloe Noah Emma Liam Ava Ethan Grace Hannah Julian Leah Martin Nora Oscar Paula Quentin Rosa Samuel Teresa Ursula Victor Wanda Xavier Yvonne Zoe".split()
ENDINGS = "son sen ton ford well man berg stein field wood worth land ley ham ez ov ski ini ard ert wick hurst by shaw dahl lund holm stad".split()
SYLLABLE = [a + b for a in ["b", "br", "c", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "qu", "r", "s", "sh", "st", "t", "tr", "v", "w", "y", "z"] for b in ["a", "e", "i", "o", "u", "al", "er", "in", "or", "el"]]
# fixed texts: mailboxes that by convention belong to an office and not to a person
ROLES = "help info support contact press sales service services admin office hello team media legal privacy careers jobs billing feedback care customercare webmaster postmaster hostmaster abuse noc security fraud disputes complaints inquiries enquiries accounts payments compliance investors investor.relations partners marketing news newsletter events recruiting hr hiring mail post noreply no-reply donotreply alerts notifications orders returns claims collections loans cards desk frontdesk reception operations treasury finance audit ombudsman".split()
# fixed texts: frames with personal pieces
POSITIVE = """
Call <NAME> at <PHONE>.
Please call me back at <PHONE>.
You can reach me on <PHONE> or at <MAIL>.
My number is <PHONE>.
My cell phone is <PHONE> if that helps.
Phone: <PHONE>
Tel. <PHONE>
Mobile <PHONE>
mobile: <PHONE>
cell: <PHONE>
home: <HOME>; mobile: <PHONE>.
Phone me on <PHONE> after eight.
Please ring me on <PHONE> before noon.
Call me on <PHONE>.
Text me at <PHONE> any evening.
I called them from <PHONE> on {month} 3 and nobody answered.
They rang <PHONE> instead of my new number <PHONE>.
Mi teléfono es <PHONE>.
Llámeme al <PHONE>, por favor.
Contact: <NAME>, <PHONE>, <MAIL>
Press contact: <NAME>, <MAIL>, <PHONE>.
For media, write to <NAME> (<MAIL>) or call <PHONE>.
E-mail: <MAIL>
Email <MAIL> for the details.
My email is <MAIL>.
my mail: <MAIL> thanks
just mail <MAIL> and ask
write me, <MAIL>, and i will send proof
drop a line to <MAIL> if you saw the same
reply to <MAIL> pls
write to <MAIL>
write to <MAIL> or call <PHONE>
Write to <MAIL> or text <PHONE>.
Write to <MAIL> for my documents.
Please contact <MAIL> or phone <PHONE>.
E-mail <MAIL> with the answer.
Send it to <MAIL> before friday.
Mail me at <MAIL>.
ask <MAIL> about it
ping <MAIL> or ring <PHONE>
They wrote to <MAIL> and to <MAIL>.
I rang from <PHONE> and left <MAIL> too.
I had given them <MAIL>.
message <MAIL> if this happened to you too
or text <PHONE> and thx
Mi correo es <MAIL>.
Escríbame a <MAIL> o llame al <PHONE>.
The form was sent from <MAIL> by mistake.
I gave them <MAIL> as well as <PHONE>.
My name is <NAME>.
My name is <NAME> and I opened {good} last year.
I am <NAME>, a client since 2019.
Me llamo <NAME> y vivo en <HOME>.
Soy <NAME> y quiero cerrar mi cuenta.
This is <NAME> writing about a charge.
Regards, <NAME>
Best, <NAME>
Kind regards, <NAME>
Yours truly, <NAME>
Sincerely, <NAME>, <PHONE>
Atentamente, <NAME>
Saludos cordiales, <NAME>, <PHONE>
Thank you, <NAME>
Signed by <NAME>
Signed on behalf of the filer by <NAME> (<PHONE>).
Prepared by <NAME>, <PHONE>
Reviewed by <title> <NAME>.
Reviewed by <title> <NAME> of the audit desk.
Posted by <NAME> on {month} 9
Posted by <NAME>
Shared by <NAME>
Written by <NAME>
Reviewer: <NAME>
By <NAME>
Account owner: <NAME>
Account holder: <NAME>, <HOME>
Beneficiary <NAME>
Beneficiary: <NAME>; address: <HOME>; phone: <PHONE>.
Co-borrower <NAME>, SSN <SSN>
My wife <NAME> has the second card.
My husband <NAME> was charged twice.
My son <NAME> and my daughter <NAME> are on the plan.
My mother, <NAME>, never got her card.
The other owner is <NAME>.
An agent called <title> <NAME> hung up on me.
The clerk, <title> <NAME>, wanted my passport <PASS>.
The teller, <NAME>, was kind.
The officer, <title> <NAME>, wrote my number <PHONE> down.
Joint owner <NAME> signed.
The joint owner is my brother <NAME>.
My partner <NAME> is an owner too.
Card holder <NAME> moved from <HOME> last year.
License <LIC>, name <NAME>.
Licence no. <LIC>, holder <NAME>.
Statements for <NAME> go to <HOME>.
Beneficiary: <NAME>; home: <HOME>; cell: <PHONE>.
<title> <NAME> told me to wait for {when}.
<title> <NAME> asked for my social security number (<SSN>).
The manager, <title> <NAME>, promised a refund.
I spoke with <NAME> and then with <NAME>.
"We are happy to help," said <NAME>, who leads the team.
Said <NAME>, head of lending: "we listen."
<NAME>, vice president, will lead the program.
The card was mailed to <NAME> at <HOME>.
They sent the statement of <NAME> to <HOME>.
Mail it to <HOME>.
Send my card to <HOME>.
Send the new card to <HOME>
Send a copy to <HOME>.
Send the paper to <HOME>
Send the check to <HOME>
Please ship the new card to <HOME>.
Ship it to <HOME> soon.
My address is <HOME>.
My home address is <HOME>.
Home address: <HOME>
Address: <HOME>
I live at <HOME>.
I live at <HOME>, so the mail went to the wrong house.
We moved from <HOME> to <HOME>.
<NAME> moved from <HOME> in spring.
The applicant <NAME> lives at <HOME>.
The borrower resides at <HOME>.
Vivo en <HOME>.
Mi dirección es <HOME>.
Envíe la tarjeta a <HOME>.
My SSN is <SSN>.
My social security number is <SSN>.
SSN: <SSN>
Social security no. <SSN>
Tax ID: <SSN>
Tax identification number on file: <SSN>.
They leaked my SSN, <SSN>, in the letter.
I had to give my social (<SSN>) twice.
Mi número de seguro social es <SSN>.
My passport number is <PASS>.
Passport <PASS> was not accepted by the check.
Passport: <PASS>
Pasaporte <PASS>
Mi pasaporte <PASS> no fue aceptado.
My driver's license is <LIC>.
Driver license no. <LIC>, issued to <NAME>.
License number <LIC> and name <NAME>
ID on file: <LIC>
Licencia de conducir <LIC>
DNI o pasaporte: <PASS>
""".strip().split("\n")
# fixed texts: frames whose numbers, names and contact points are not personal
NEGATIVE = """
Questions? E-mail <role>.
Write to <role> for help.
Contact <role>.
Mail us at <role> or use the form.
For complaints write to <role>.
Escriba a <role>.
Reach the press office at <role>.
Send documents to <role> before the deadline.
Call us toll-free at <toll>.
Our toll-free number is <toll>.
Our customer line <toll> is open all day.
Call <toll> at any time.
Llame gratis al <toll>.
Headquarters: <office>
The head office of {firm} is at <office>.
{firm} is located at <office>.
{firm}, <office>
{nick} {nick} Holdings, Inc. is at <office>.
Our offices are at <office>.
Write to {bank}, <office>.
The branch at <office> is closed.
Case <case> is closed.
Your case number is <case>.
Reference <case> was opened in {month}.
My case <case> is still open.
They closed case <case> without a word.
Ticket no. <case>
Form <ssnlike> lists all fees.
See form no. <ssnlike>.
Disclosure form <ssnlike> applies.
Routing number <nine>
The routing number of {bank} is <nine>.
ABA routing no. <nine>
Account ending in <four>
The card ending in <four> was blocked.
Card number **** **** **** <four>
SSN ***-**-<four> is masked.
Social security number: ***-**-<four>
Filer <seven> changed its form.
Filer <seven> reported total assets of {usd}.
ID RSSD <seven> left the panel in 2014.
Restated by {usd} thousand since 2009.
Line {n} was restated.
The total of the batch is 412,771.2500 units.
The job ran at 2019-04-02 11:40.
Updated 2020-11-30.
Version 3.14.15 of the app
Section 12. {who} may {do}.
14.02 This part is governed by state law.
Terms 8.1 to 8.4 apply.
Invoice 20394857
Order 99817 shipped.
{n} out of {n} {who} would {do} again.
In {month} 2018 the {good} had 44,000 users.
{firm} said that the {good} now serves {n},000 {who}.
"We want {who} to {do}," the chief of {firm} said.
The partnership with {bank} will grow in 2020.
{bank} and {firm} signed a deal.
{firm} is not a bank; accounts are held at {bank}.
{nick} is better than {nick}.
{firm} pays {bank} a share.
{firm} built the {good} for {who}.
{firm} made the {good} to help {who} {do}.
{firm} said on {month} 12 that it will {do}.
{firm} feels {how} but {what} is slow.
{who} {do} with {firm}.
Join {n},000 {who} who {do} with {firm}.
many {who} {do} with {firm} now
Head office of {firm}: <office>
The head office of {firm} is in another state.
I asked {firm} to {do} and got no answer.
I opened {good} in {month} 2020.
I want my {usd} back.
They took {usd} from my account and blamed {what}.
Update {month}: they paid {usd} back, so one more star.
4/5 would use it again :)
does anyone know how to {do}??
anyone else stuck with {what}? support said {when}
honestly {good} is fine, took {when} tho
lol, they charged {usd} for nothing
thx for the tip, it works now
It works. Try again if the code fails.
If it fails after {when}, check {what}.
Tap the gear, then follow the prompts to {do}.
Note: {who} see this {where} only.
Street smart {who} {do}.
March and May are slow months.
Will Grant loans be paid? The grant programme ends in {month}.
Chase returns, mark gains and bill fees are terms of trade.
Main Street lenders welcome the rule.
New York and North Dakota residents may {do}.
Monday to Friday, 9 to 5
El límite diario es de {usd}.
La cuenta rinde un {pct} anual.
La tarjeta {good} no tiene cuota.
{firm} no es un banco.
Los fondos llegan en {when}.
Puede cerrar la cuenta sin coste en 30 días.
Revise su estado de cuenta y avísenos en {when}.
Si ve un cargo raro, díganos.
total = fee * {n};
if (fee > 0) { return; }
=====
-----
""".strip().split("\n")
TITLES = ["Ms.", "Mr.", "Dr.", "Mrs.", "Prof.", "Sr.", "Sra.", "Miss"]


def _made(rng: random.Random, least: int = 2, most: int = 3) -> str:
    return "".join(rng.choice(SYLLABLE) for _ in range(rng.randint(least, most))).capitalize()


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _given(rng: random.Random) -> str:
    return rng.choice(GIVEN) if rng.random() < 0.5 else _made(rng)


def _family(rng: random.Random) -> str:
    return _made(rng, 1, 2) + rng.choice(ENDINGS) if rng.random() < 0.7 else _made(rng)


def _phone(r: random.Random) -> str:
    a, b, c = str(r.randint(201, 989)), str(r.randint(200, 999)), _digits(r, 4)
    s = r.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"{a}{b}{c}", f"({a}) {b} {c}", f"{a} {b} {c}", f"+1 ({a}) {b}-{c}", f"+44 20 7{_digits(r, 3)} {c}", f"+34 6{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)}", f"+52 55 {c} {_digits(r, 4)}"])
    return s + (f" {r.choice(['ext.', 'x', 'ext', 'extension'])} {_digits(r, r.randint(2, 4))}" if r.random() < 0.12 else "")


def _street(r: random.Random) -> str:
    side = r.choice(["", "", "", "East ", "N. ", "West ", "South ", "NE "])
    return f"{side}{_made(r)} {r.choice(['Street', 'Ave.', 'Avenue', 'Court', 'Way', 'Drive', 'Lane', 'Terrace', 'Rd', 'St', 'Blvd', 'Road', 'Place', 'Circle', 'Ct', 'Dr', 'Parkway'])}"


# fixed texts: what firms, products and banks are called by
FIRMS = ["Financial", "Financial Ltd", "Labs", "Pay", "Wallet", "Money", "Payments", "Payments, Inc.", "Capital", "Technologies Inc.", "Holdings", "Credit", "Finance Group", "Money Corp.", "Financial LLC"]
GOODS = ["Credit Card", "Rewards Card", "Debit Card Plus", "Savings Account", "Checking Account", "Personal Loan", "Line of Credit", "Cash Advance", "Money Transfer", "Credit Builder", "Prepaid Card", "Investment Account", "Certificate of Deposit", "Business Account"]
BANKS = ["Bank", "State Bank", "National Bank", "Trust Company", "Bank & Trust", "Savings Bank", "Commercial Bank", "Bank N.A.", "Community Bank"]
STATES = "AL AZ CA CO CT FL GA IA ID IL IN KS KY MA MD ME MI MN MO MT NC ND NE NJ NM NV NY OH OK OR PA SC TN TX UT VA VT WA WI WY".split()  # fixed values


def _city(r: random.Random) -> str:
    return f"{_made(r)}{r.choice(['', '', '', ' Falls', ' Springs', ' Bay', ' City', ' Park', ' Heights', ' Beach'])}, {r.choice(STATES)} {_digits(r, 5)}"


def piece(kind: str, rng: random.Random) -> str:
    """One filled slot."""
    r, d = rng, _digits
    if kind == "NAME":
        given, family = _given(r), _family(r)
        if r.random() < 0.12:
            family += "-" + _family(r)
        k = r.random()
        s = f"{given} {family}" if k < 0.58 else f"{family}, {given}" if k < 0.7 else f"{given[0]}. {family}" if k < 0.82 else f"{given} {r.choice('ABCDEFGHJKLMNPRSTW')}. {family}" if k < 0.94 else f"{given} {_given(r)} {family}"
        return s.upper() if r.random() < 0.1 else s
    if kind == "PHONE":
        return _phone(r)
    if kind in ("MAIL", "role"):
        g, f = _given(r).lower(), _family(r).lower()
        user = r.choice(ROLES) if kind == "role" else r.choice([f"{g}.{f}", f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}{f}", f"{g[0]}{f}", f"{f}{g[0]}", f, f"{f}{d(r, 2)}", f"{g}{d(r, 3)}", f"{f}.{g}", f"{g}_{f}+{_made(r, 1, 1).lower()}", f"{g}.{f}{d(r, 2)}"])
        host, top = r.choice(["", "", "mail.", "post."]) + _made(r).lower(), r.choice(["example", "test", "invalid", "com", "org", "net", "co"])
        s = r.choice([f"{user}@{host}.{top}"] * 6 + ([f"{user} (at) {host}.{top}", f"{user} [at] {host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user} (at) {host} (dot) {top}", f"{user} at {host} dot {top}"] if kind == "MAIL" else []))
        return s.upper() if r.random() < 0.1 else s
    if kind == "SSN":
        sep = r.choice(["-", "-", "-", " ", ".", ""])
        return f"{r.randint(100, 999)}{sep}{d(r, 2)}{sep}{d(r, 4)}"
    if kind == "PASS":
        return r.choice("ABCDEFGHKLMNPQRTXYZ") + d(r, r.choice([7, 8]))
    if kind == "LIC":
        return r.choice([f"{r.choice('ABCDKLMS')}{d(r, 3)}-{d(r, 4)}-{d(r, 4)}", f"{r.choice('ABCDKLMS')}{d(r, 7)}", f"{r.choice('ABDS')}{d(r, 4)}-{d(r, 5)}"])
    if kind in ("HOME", "office"):
        s = f"{r.randint(1, 9999)} {_street(r)}" if kind == "office" or r.random() < 0.85 else f"{r.choice(['P.O. Box', 'PO Box'])} {r.randint(1, 9999)}"
        if r.random() < 0.35 and "Box" not in s:
            s += r.choice([f", Unit {r.randint(1, 40)}", f" #{r.randint(1, 400)}", f", Apt {r.randint(1, 40)}{r.choice('ABC')}", f", Apt. {r.randint(1, 40)}", f", Suite {r.randint(100, 900)}", f", Floor {r.randint(2, 40)}"])
        return s + (f", {_city(r)}" if r.random() < 0.85 else "")
    return {
        "title": lambda: r.choice(TITLES),
        "toll": lambda: r.choice([f"1-{t}-{d(r, 3)}-{d(r, 4)}" for t in (800, 833, 844, 855, 866, 877, 888)] + [f"({r.choice([800, 888, 877])}) {d(r, 3)}-{d(r, 4)}", f"1 {r.choice([800, 866])} {d(r, 3)} {d(r, 4)}"]),
        "case": lambda: r.choice([f"{d(r, 4)}-{d(r, 4)}-{d(r, 4)}", f"{d(r, 4)}-{d(r, 4)}-{d(r, 4)}", f"#{d(r, 6)}", f"CASE-{d(r, 7)}"]),
        "ssnlike": lambda: f"{r.randint(100, 999)}-{d(r, 2)}-{d(r, 4)}",
        "nine": lambda: d(r, 9),
        "four": lambda: d(r, 4),
        "seven": lambda: d(r, 7),
    }[kind]()


KIND = {"NAME": "person_name", "MAIL": "email", "PHONE": "phone", "SSN": "id_number", "PASS": "id_number", "LIC": "id_number", "HOME": "street_address"}
SLOT = re.compile(r"<(\w+)>")


def sentences(copies: int = 36, seed: int = 5, held: bool | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(from, to, kind)]): filled frames, each led and followed by a piece of another one; of the frames held out, of the others, or of all."""
    rng = random.Random(seed)
    mine = lambda frames: [f for i, f in enumerate(frames) if held is None or (i % 5 == 4) == held]
    positive, negative = mine(POSITIVE), mine(NEGATIVE)
    spare = [*negative, *negative, *mine(labelled_pages.BODY), *mine(labelled_pages.FURNITURE)]

    def invented(s: str) -> str:
        # firms, products and banks of two invented words stand where names could stand
        two = f"{_made(rng)} {_made(rng)}"
        for slot, tails in (("{firm}", FIRMS), ("{good}", GOODS), ("{bank}", BANKS)):
            while slot in s and rng.random() < 0.7:
                s = s.replace(slot, f"{two} {rng.choice(tails)}", 1)
                two = f"{_made(rng)} {_made(rng)}"
        return s

    def filled(frame: str, at: int) -> tuple[str, list[tuple[int, int, str]]]:
        text, marks, last = "", [], 0
        frame = invented(frame)
        for m in SLOT.finditer(frame):
            text += labelled_pages.fill(frame[last : m.start()], rng)
            s = piece(m[1], rng)
            if m[1] in KIND:
                marks.append((at + len(text), at + len(text) + len(s), KIND[m[1]]))
            text += s
            last = m.end()
        return text + labelled_pages.fill(frame[last:], rng), marks

    out = []
    for frame, n in [*((f, copies * 2 if "<HOME>" in f or "<SSN>" in f else copies) for f in positive), *((f, copies if "<" in f else copies // 3) for f in spare)]:
        for _ in range(n):
            lead, _ = filled(rng.choice(spare), 0) if rng.random() < 0.5 else ("", [])
            lead += rng.choice([" ", "  "]) if lead else ""
            text, marks = filled(frame, len(lead))
            if not marks and rng.random() < 0.12:
                text = text.upper()
            tail, more = filled(rng.choice([*spare, *positive]), len(lead) + len(text) + 1) if rng.random() < 0.5 else ("", [])
            out.append((lead + text + (" " + tail if tail else ""), marks + more))
    return out
