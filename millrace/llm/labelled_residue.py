"""Labelled field values from which the residue models are fitted: slots, filler, notices and natural text.

Written for this purpose: the syntax of public template languages, the usual filler, messages of public servers,
browsers and spreadsheets, and titles, rates and lines as sites word them. Entries fall into FOLDS folds by their
place; each fold in turn is held out of the models that set the limits on it.
"""

from __future__ import annotations

import random
from functools import lru_cache

from millrace.llm import labelled_pages

FOLDS = 5
# fixed texts: placeholder syntax of template languages and the identifiers put into it
SLOT_FORMS = ["{{%s}}", "{{ %s }}", "${%s}", "#{%s}", "<%%= %s %%>", "{%% %s %%}", "[[%s]]", "<<%s>>", "%%%%%s%%%%", "@@%s@@", "__%s__", "[%s HERE]", "[INSERT %s]", "{%s}", "$%s$", "[[ %s ]]", "${ %s }", "[Your %s]", "{{{%s}}}", "*|%s|*", "[%s]", "<%% %s %%>"]
SLOT_NAMES = ["name", "title", "price", "user.name", "first_name", "lastName", "site.title", "total", "headline", "image_url", "ORDER_ID", "button.label", "t('welcome')", "rate1", "interest_rate", "company", "partner.logo", "amountDue", "data.value", "seo_text", "x", "body_copy", "FEE_2"]
# fixed texts: filler copy and dummy values
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Lorem ipsum {lorem} {lorem} {lorem} {lorem}
Lorem ipsum {lorem}
{lorem} {lorem} {lorem} {lorem} {lorem} {lorem} {lorem}.
{lorem} {lorem} {lorem} {lorem} {lorem}, {lorem} {lorem} {lorem} {lorem}
lorem ipsum
lorem %
Lorem
Sample text
Sample copy, replace before launch.
Sample page
Placeholder
Placeholder text
Placeholder copy, to be replaced by marketing.
Placeholder headline
Dummy text
Dummy copy goes here
Your text here
Your text goes here
Your headline goes here
Your title here
Title goes here
Subtitle goes here
Heading goes here
Description goes here. Describe the product here.
Describe your product in two lines.
Insert text here
Insert copy
Insert title
insert amount here
Add text here
[Add text]
[Add copy here]
[Add legal copy]
[placeholder]
[placeholder text]
[insert]
Text text text
text text text text text text
text text
blah blah blah
bla bla bla
foo bar baz
foo
asdf
asdf asdf asdf
asdfgh
qwerty
test
test test
test test test
This is a test
Testing 123
xxx
xxxx xxxx
xxx xx xxxx xxxxx xxx
XXXXX
aaa bbb ccc
abc abc
Untitled
Untitled Document
Untitled page
Untitled 1
New Page
New Page 1
No title
Page title
Blank page
undefined
undefined%
undefined undefined
undefined | {firm}
undefined - {firm}
null
null%
null null
NaN
NaN%
NaN% APR
None%
Infinity%
XX.X%
XX%
xx.x%
xx%
x%
X.XX%
x.xx% APY
XX.XX% - XX.XX% APR
xx.x% to xx.x%
0.00% (placeholder)
{pct} (sample)
{n}% (sample)
{pct} (example only)
{n}% (dummy)
__.__%
--.--%
--%
??%
??.??%
???
TBD
TBD%
TBA
to be determined
to be confirmed
TODO
FIXME
N/A%
Loading...
Loading
Please wait...
Coming soon
[object Object]
[object HTMLElement]
#REF!
#VALUE!
#N/A
#NAME?
#DIV/0!
#NUM!
#NULL!
""".strip().split("\n")
# fixed texts: the words of the usual filler
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat".split()
# fixed texts: notices that servers, scripts and parked domains put in place of content
NOTICES = """
400 Bad Request
401 Unauthorized
401 Authorization Required
403 Forbidden
404 Not Found
404
404 error
404 - Page not found
405 Method Not Allowed
408 Request Timeout
410 Gone
429 Too Many Requests
500 Internal Server Error
501 Not Implemented
502 Bad Gateway
503 Service Unavailable
503 Service Temporarily Unavailable
504 Gateway Time-out
520 Web server returns an unknown error
Error
Error {n}
Error 404
Error 500: server error
{n} error
HTTP Error {n}
HTTP Status {n}
HTTP Status 404 - Not Found
HTTP 500
{firm} | 404 Not Found
{firm} - 403 Forbidden
{firm} - 500 Internal Server Error
404 Not Found - {firm}
502 Bad Gateway | {firm}
410 Gone | {firm}
{firm}: 503 Service Unavailable
Not Found
Not Found. The requested URL was not found on this server.
The requested URL {n} was not found on this server.
The page you requested could not be found.
The page you are looking for does not exist or has been moved.
Sorry, we could not find the page you were looking for. Error {n}
Sorry, that page does not exist
Page not found
Page Not Found | {firm}
Page not found (404)
{firm} - Page not found
This page can't be found
This page is not available
This page isn't working
This page no longer exists
This content is no longer available
We can't find the page you are looking for
Oops! That page can't be found.
Oops, something went wrong
Oops! Something went wrong | {firm}
Something went wrong. Please try again later.
An error occurred
An error has occurred while processing your request.
An unexpected error occurred. Reference {n}
Application error: a client-side exception has occurred.
Problem loading page
Unable to connect
Unable to load content
Server error
Server Error in '/' Application
Server not found
Internal error. Please contact the administrator. Code {n}
Fatal error: uncaught exception in index on line {n}
Fatal error: allowed memory size exhausted in /var/www/html on line {n}
Warning: cannot modify header information in /var/www on line {n}
Traceback (most recent call last)
Error establishing a database connection
Database error
Bad request. Your browser sent a request that this server could not understand.
Bad gateway. The upstream server returned an invalid response. Code {n}
Upstream connect error or disconnect before headers, code {n}
Upstream request timed out: no healthy upstream
Gateway timeout: the server did not respond in time ({n}).
The connection has timed out. The server is taking too long to respond.
Connection refused
Request failed
Request blocked
Service Unavailable
Service temporarily unavailable. Please try again later.
Error: service unavailable
Error: could not load data
Error: rate could not be loaded
Temporarily offline
Site offline
Site under maintenance
Under maintenance
We are down for maintenance and will be back soon.
This site is undergoing scheduled maintenance. Please check back later. Ticket {n}
We'll be back shortly. Scheduled maintenance is being performed.
Website under construction
Under construction
Access Denied
Access denied
Access denied | {firm}
Access to this page has been denied.
Access Denied. You do not have permission to access this resource on this server. Reference #{n}
You are not authorized to view this page.
Forbidden. You don't have permission to view this directory.
Attention Required!
Attention Required! | Security check
Just a moment...
One moment, please...
Please wait while we check your browser
Checking your browser before accessing this site. This process is automatic.
Please verify you are a human
Verify you are human to continue. Ray ID {n}
Complete the action below to continue. Ray {n}
Are you a robot?
Security check required
Unusual traffic from your network was detected. Incident {n}
Your IP address has been blocked.
Too many requests. Please slow down and try again in {n} seconds.
Rate limit exceeded
Session expired
Your session has expired. Please log in again.
Session timed out
Please enable JavaScript
Please enable JavaScript to continue
Please enable JavaScript to view this page
Please enable JavaScript to see prices
JavaScript is required
JavaScript is disabled in your browser. Please switch it on and reload.
This app requires JavaScript. Turn it on to run this application.
This site requires JavaScript to be enabled.
You need to enable JavaScript to run this app.
You need to turn on scripts in your browser to use {firm}.
Scripts are blocked, so the content of this page cannot be shown.
noscript: enable scripts in your browser to see content
Cookies must be enabled to view this site.
Your browser is not supported
Your browser is out of date. Upgrade to a recent version to view this site.
This browser is no longer supported by {firm}.
Flash player required
Domain for sale
This domain is for sale
{firm}: this domain is for sale
This domain is parked
This domain is parked free, courtesy of the registrar.
Domain parked
Domain expired
This domain name has expired. Renew it with the registrar. Ref {n}
Buy this domain
Account suspended
This account has been suspended. Contact your hosting provider.
Website suspended
Index of /
Index of /public_html
Welcome to nginx!
If you see this page, the web server is successfully installed and working.
Apache2 Default Page
Apache2 Ubuntu Default Page: It works
It works!
It works! This is the default page of this server.
Default web page
Default site
IIS Windows Server
Test page for the web server
Future home of something quite cool.
Redirecting...
You are being redirected
Moved Permanently
Gone. We removed this page. Back to the start page of {firm}.
We lost this page. Go back to the start page of {firm}.
""".strip().split("\n")
# fixed texts: titles and rates of real fields, among them some that share words with notices
NATURAL = """
{good}
{good}
{good}: rates
{good}: fees, rates and limits
{good} | {firm}
{firm} - {good}
{firm} | {good}
{firm}
{firm} | Home
{firm} Disclosures
{firm} Help
{firm}: Terms of Use
Terms | {firm}
Privacy | {firm}
Terms of Service | {firm}
Terms of Service - {firm}
Privacy Policy - {firm}
Privacy Notice | {firm}
Account Agreement - {firm}
Cardholder Agreement | {firm}
Deposit Agreement | {firm}
{firm} Legal
Fee Schedule - {firm}
FAQ | {firm}
{n} Rewards Club | {firm}
{n} Points Club
404 Rewards | {firm}
500 Club Rewards | {firm}
403 Miles Club
{n} ways to save | {firm}
Service Members | {firm}
Service fee | {firm}
Error Resolution | {firm}
Error reporting procedures | {firm}
How to fix an error on your statement
Billing errors and disputes | {firm}
Lost or not found card? | {firm}
Card not found at checkout? Here is help
Denied credit? Build it with the {good}
Accounts for people denied elsewhere | {firm}
Access your account abroad
Access codes and security | {firm}
JavaScript library for payments | {firm}
Developers: JavaScript and Python kits
Enable alerts | {firm}
Enable card controls in the app
Construction loans | {firm}
Home under construction? Loans for builders
Maintenance fee | {firm}
Monthly maintenance fee waiver
Website accounts for shops | {firm}
Domain names and business accounts | {firm}
Session replay and privacy | {firm}
Session limits for guests
Gateway payments for shops | {firm}
Server and hosting costs for small shops
Sample size of our savings survey
Test drive loans | {firm}
Placeholder names in wire forms explained
Human support | {firm}
{pct}
{pct} APR
{pct} APY
{pct}-{pct}
{pct} - {pct}
{pct} - {pct} APR
{pct}-{pct} APR
{pct} to {pct} APY
{pct} [1]
{pct} [2]
{pct}[3]
{pct} (1)
{pct} *
{pct} (up to {usd})
{pct} (on balances up to {usd})
{pct} (promotional)
{pct} (intro), then {pct}
{pct}–{pct} APR
{pct}–{pct}
{pct}% APY
up to {pct}
from {pct}
as low as {pct}
Prime + {pct}
SOFR plus {pct}
variable
fixed
variable APR
none
no interest
nan
0%
0.00%
{n}
{n}%
0.{n}
{n}.{n}%
""".strip().split("\n")
# fixed texts: lines that hold the marks of templates or the words of notices and are neither
MARKED = """
Fees marked [{n}] are set by the card network.
See note [{n}] and note [2] below.
Limits are {usd} (see [1]) and {usd} (see [2]).
Send {"amount": {n}, "currency": "USD"} to the transfers endpoint.
The payload {"id": {n}} is returned; see the {id} part of the path.
An array such as [{n}, 4, 7] lists the limits.
if (balance < 0) { chargeFee(balance); }
const total = items[0].price * {n};
for i in range({n}): print(i)
return rate * 100;
SELECT * FROM accounts WHERE id = {n};
Balances under {usd} pay {usd} - {usd} a month.
{usd}/month, {usd}/year
{usd} & {usd} % of users
A 100% free account, 50% fewer fees
Call *{n}# from any phone
Write <b> for bold and </b> to end it.
Rated #1 by {who}
See section 4(b)(ii) and [sic] in the notice.
Use the @ sign to tag {who}.
The name in the placeholder field is an example only.
A sample statement is shown in the welcome kit.
The test deposit of {usd} proves that you own the account.
Our API returns 404 if no account has that id, and 500 if it fails.
If the code is not found, ask for a new one.
If access is denied at an ATM, call the number on your card.
JavaScript must be loaded by the shop before checkout begins.
The server of the clearing house may be unavailable on holidays.
Errors on your statement must be reported within {when}.
Maintenance of the app is done at night.
The page that lists your limits was moved to settings.
""".strip().split("\n")


def fill(pattern: str, rng: random.Random) -> str:
    """The pattern with its slots filled; of firms, products and banks only the kind words are kept, as names prove nothing."""
    s = pattern
    while "{lorem}" in s:
        s = s.replace("{lorem}", rng.choice(LOREM), 1)
    for k, tail in (("{firm}", ["Pay", "Labs Inc.", "Wallet", "Money Corp.", "Finance Group", "Holdings LLC", "Credit, Inc.", "Technologies", "Capital Ltd", "Payments"]), ("{bank}", ["State Bank", "Trust Company", "Bank & Trust", "National Bank N.A."]), ("{good}", ["Credit Card", "Debit Card", "Savings Account", "Line of Credit", "Personal Loan Plus", "Cash Advance", "Credit Builder", "Money Transfer", "Certificate of Deposit", "Prepaid Card Junior", "Business Account", "Checking Account", "Rewards Card 2", "Investment Account"])):
        while k in s:
            s = s.replace(k, rng.choice(tail), 1)
    if "{n}" in s:
        s = s.replace("{n}", str(rng.randint(2, 60000)))
    return labelled_pages.fill(s, rng)


def slip(s: str, rng: random.Random) -> str:
    """`s` with one typed slip."""
    if len(s) < 5:
        return s
    i = rng.randint(1, len(s) - 2)
    return rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + rng.choice("aeiorstn") + s[i:], s[:i] + rng.choice("aeiorstn") + s[i + 1 :]])


@lru_cache(maxsize=16)
def values(seed: int = 11, fold: int | None = None, held: bool = False) -> list[tuple[str, str]]:
    """(class, text) of every labelled value: 'slot', 'filler', 'notice' or 'natural'; of a fold if held, of all others else."""
    rng = random.Random(seed)
    out: list[tuple[str, str]] = []
    take = lambda i: fold is None or (i % FOLDS == fold) == held
    lines = [p for i, p in enumerate([*labelled_pages.BODY, *labelled_pages.FURNITURE, *MARKED]) if take(i)]
    for i, nm in enumerate([*SLOT_NAMES, *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz_.") for _ in range(rng.randint(3, 9))) for _ in range(40))]):
        if take(i):
            for form in SLOT_FORMS:
                out.append(("slot", form % rng.choice([nm, nm.upper(), nm])))
    for i, p in enumerate(FILLER):
        if take(i) or "{lorem}" in p:
            out += [("filler", fill(p, rng)) for _ in range(60 if "{lorem}" in p or len(p) < 8 else 24)]
    for i, p in enumerate(NOTICES):
        if take(i):
            for k in range(16):
                s = fill(p, rng)
                out.append(("notice", slip(s, rng) if k % 4 == 3 else s))
    for i, p in enumerate(NATURAL):
        if take(i):
            out += [("natural", fill(p, rng)) for _ in range(240 if len(p) < 16 else 48)]
    for p in lines:
        n = 5 if p in MARKED else 1
        out += [("natural", fill(p, rng)) for _ in range(40 if len(p) < 16 else 6 * n)]
        out += [("natural", fill(p, rng) + rng.choice("\n ") + fill(rng.choice(lines), rng) + rng.choice(["\n", " ", "\n- "]) + fill(rng.choice(lines), rng)) for _ in range(24 * n)]
    return out
