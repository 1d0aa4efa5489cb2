"""Labelled lines of web pages, from which the weights of the body extractor are fitted.

Written for this purpose, as such pages are worded in general, and extended where the extractor erred. Each line is a
pattern with slots in braces, which `lines()` fills. One list holds furniture of the site, the other what a
page says about its product. Every fifth pattern is held out: it fits nothing and only measures.
"""

from __future__ import annotations

import random
import re

# fixed texts: words for the slots
SLOTS = {
    "who": ["people", "account owners", "young adults", "retirees", "shop owners", "newcomers", "parents", "contractors", "existing clients", "co-signers", "drivers", "households"],
    "what": ["your plan", "the app", "your debit card", "the loan agreement", "a recurring transfer", "your online profile", "the billing cycle", "an overdraft", "your credit report", "the statement balance", "a wire", "a mobile deposit", "the PIN"],
    "do": ["pay bills", "send cash abroad", "set up alerts", "withdraw at an ATM", "raise a limit", "skip a payment", "add a beneficiary", "deposit a check", "split a purchase", "cancel a card", "earn points", "track spending", "pay off early", "roll over a balance"],
    "where": ["in the app", "by phone", "online", "at any branch", "abroad", "in all fifty states", "at the register", "by mail"],
    "when": ["one day", "3 business days", "two weeks", "ten days", "45 days", "one billing cycle", "24 hours", "six months"],
    "how": ["easy", "fast", "smart", "free", "better", "modern", "secure", "fee-free", "convenient", "powerful", "personal", "low-rate"],
    "usd": ["$10", "$1,500", "$0", "$34.99", "$250,000", "$7.50", "$400"],
    "n": ["2", "14", "2021", "365", "1.5"],
    "pct": ["3.90%", "24.99%", "0.01%", "12%"],
    "month": ["February", "April", "July", "September", "November"],
    "firm": ["Orvanta Finance", "Belquor Money Inc.", "Thessik Pay", "Nuvolane Capital LLC", "Garrowby Wallet", "Pellum Labs", "Corvid Technologies"],
    "nick": ["Orvanta", "Belquor", "Thessik", "Nuvolane"],
    "good": ["Orvanta Cash Card", "Thessik Savings", "Belquor Flex Loan", "Nuvolane Checking Account", "Garrowby Rewards Card", "Pellum Business Account", "Corvid Line of Credit", "Orvanta Money Transfer", "Belquor Certificate of Deposit", "Thessik Prepaid Card", "Pellum Investment Account", "Corvid Credit Builder", "Garrowby Cash Advance"],
    "bank": ["Harlan Creek Bank", "First Odessa National Bank, N.A.", "Pinefield Trust Company", "Tallow Bank & Trust", "Merrin Savings Bank", "Union Valley State Bank", "Coldwater Community Bank", "Essex Federal Savings Bank"],
    "nav": ["Home", "About us", "Contact", "Careers", "Newsroom", "Press", "Investors", "Pricing", "Support", "Help", "FAQ", "Blog", "Learn", "Security", "Legal", "Cards", "Loans", "Savings", "Checking", "Personal", "Business", "Partners", "Developers", "Community", "Rewards", "Log in", "Sign up", "Privacy", "Terms", "Accessibility", "Sitemap", "Company", "Products", "Features", "Mobile app", "Invest", "Disclosures", "Cookies", "Login", "Resources", "Status", "Mortgages", "Locations", "Invite", "Explore"],
    "sep": [" ", "  ", " | ", " / ", " > ", " • ", " · ", " - ", " » ", " › "],
}
DECORATION = ["• ", "> ", "» ", "* ", "— ", "\t", "- ", "  "]
# fixed texts: what a site puts around its pages
FURNITURE = """
{nav}
{nav}{sep}{nav}
{nav}{sep}{nav}{sep}{nav}
{nav}{sep}{nav}{sep}{nav}{sep}{nav}
{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}
{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}
{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}{sep}{nav}
Menu
☰
☰ Menu
Open menu
Close ×
Toggle menu
Main navigation
Skip to content
Skip to main
Jump to footer
Back to top ↑
Back to {nav}
Search
Search...
Search our site
Search for answers Go
What are you looking for?
Type to search
Log in
Log in | Sign up
Log in or create an account
Sign in to your account
Sign in Register
Username Password Remember me
Forgot your password?
Already have an account? Log in
New here? Sign up
Sign up free
My account
Open an account
Open account Sign in
Get started
Get started today
Apply now
Join now
Start now
Learn more
Learn more >
Read more
See all
Watch the video
Book a demo
Talk to sales
Download the app
Get the app
Available on the App Store and Google Play
Scan the code to get the app
Home > {nav}
Home > {nav} > {nav}
Home / {nav} / {nav}
Home » {nav} » {good}
You are here: {nav} > {nav}
You are in: {nav}
We use cookies
We use cookies to give you a better experience. Accept
This website uses cookies and similar technologies to analyse traffic.
By continuing to browse you agree to our use of cookies.
By clicking accept you consent to the storing of cookies on your device.
Accept all cookies
Accept all Reject all
Accept all | Manage preferences
Manage cookie settings
Cookie settings
Cookie policy
Only necessary cookies
Your privacy choices
Do not sell my personal information
We and our partners store and access information on a device for ads and analytics.
We care about your privacy and use trackers to improve our site. Decline
Strictly necessary Performance Targeting Save choices
Update your consent preferences
Subscribe
Subscribe to our newsletter
Sign up for our newsletter
Enter your email Subscribe
Get tips in your inbox every week
Follow us
Follow us on social media
Follow us on Facebook, Twitter and LinkedIn
Facebook Twitter Instagram LinkedIn YouTube
Share this page
Share on Facebook Tweet Email
Like us, tweet us, tag us
© 2021 {firm}
© 2019 {firm}. All rights reserved.
Copyright {firm} 2018-2022
All rights reserved
All trademarks belong to their owners. All rights reserved.
Terms of use | Privacy policy | Cookie policy
Terms | Privacy | Licenses | Complaints
Terms of service Privacy notice Accessibility
Privacy policy
Terms & conditions
Legal notices · State licenses · Sitemap
Made with love in the city
Proudly built by the team at {nick}
Contact us
Contact us Help center Careers
Need help? Visit our help center
Need a hand? Chat with us
Chat with us now
Have questions? Call us or start a chat
Call us Mon-Fri 9 to 5
Download our app for iOS and Android
English | Español
Change language
Choose your country
Select region: United States
Related articles
Related posts
Popular this week
Recommended for you
You may also like
You might like: {good}
People also read: how {who} {do}
Latest news
Latest from our blog: {n} ways to save
From the blog: why {who} love budgeting
Trending: {n} money habits for {month}
More from {nick}
More guides: saving, budgeting, investing
Recent posts
Meet our team
Meet the founders of {nick}
We are hiring! See open roles
Join our team
Refer a friend and get {usd}
Refer friends, earn {usd} each
Invite a friend and you both get {usd}!
Get a {usd} bonus when you sign up by {month}!
Limited time: get {usd} when you join
Limited-time offer! Switch today
Hurry, offer ends {month} {n}!
Don't miss out! Claim your bonus
Special offer: {n} months free. Sign up
Win {usd}! Enter our giveaway
Try the new {nick} app today!
NEW! Meet the redesigned {nick}
Big news! {nick} won an award
{nick} has been named best wallet of {n}
As seen in the press
Rated {n} stars by {n}k users
Trusted by {n} million customers
Over {n} million downloads. Join us!
See why {n},000 people love {nick}
What our customers say
"Best app ever!" - a happy customer
Thanks for stopping by
Thanks for visiting {nick}
Print this page
Was this page helpful? Yes No
Rate this article
Loading comments
Advertisement
Sponsored
Page {n} of {n}
Previous Next
Previous article
Next article: {n} ways {who} {do}
Next: how {nick} began >>
Next post: the truth about {what} >>
<< Older posts
Popular articles
Popular posts: {n} ways to {do}
Top stories for {who}
Editor's pick: why {who} love {what}
Story: how {who} {do} with a smile
In the news: {nick} meets {who}
Tags: saving, credit, tips
Tags: {how}, {who}, finance
Categories: budgeting, credit, money tips
Topics: {how} money, {who}, ideas
Filed under: {nav}, {nav}
Loading...
Loading more posts...
Loading related stories...
Show more posts
Load more
More stories
You might also like the {how} app for {who}
You may also enjoy: the {how} card for {who}
People like you also viewed {good}
Connect with us
Connect with us on social: photos, reels, posts
Find us online: photos, news, videos
Videos Podcasts Photos
Logos and trademarks are property of their owners.
All other marks are property of their holders. {firm} {n}.
The {firm} name and logo are registered trademarks. {n}
{firm} {n}
{firm} | Imprint | Legal
English Deutsch Français
English Español
Italiano Español English
Okay! We and our vendors use cookies for ads.
Got it
Got it! Cookies help us to measure our ads and analytics.
Our vendors and partners use trackers for analytics. OK
No thanks
{nick} is on a mission. Meet our story
Celebrate {n} years of {nick} with us!
{nick} moved to a new home. Read our news
""".strip().split("\n")
# fixed texts: what a page says about its product, its fees, rates, rules, bank and insurance
BODY = """
{good}
About the {good}
{good} overview
{good} terms and conditions
{good}: rates and fees
How it works
How the {good} works
How do I {do}?
Can I {do} {where}?
What happens if {what} is late?
Who can apply?
Who is eligible for the {good}?
Is my money safe?
Is there a minimum balance?
When will I get my money?
Why was {what} declined?
Do I have to pay to {do}?
Fees
Fees and charges
Rates
Rates and terms
Eligibility
Key features
Key facts
Benefits
Requirements
Limits
Spending limits
Important information
Important disclosures
Frequently asked questions
Schedule of fees
Account details
Repayment
Deposit insurance
Overdraft protection
Q: Can {who} {do}?
A: Yes, {who} can {do} {where}.
A: No. You must first {do} {where}.
Question: How long does a transfer take?
Answer: It usually takes {when}.
Monthly fee: {usd}
Monthly maintenance fee | {usd}
ATM withdrawal | {usd}
ATM fee outside the network: {usd}
Annual fee {usd}
Late fee: up to {usd}
Late payment | up to {usd}
Foreign transaction fee | {pct}
Balance transfer fee {pct} or {usd}, whichever is greater
Cash advance {pct}
Minimum opening deposit: {usd}
Minimum to open {usd}
APR: {pct} to {pct}
APY {pct}
Interest rate {pct}
Purchase APR {pct} variable
Replacement card {usd}
Wire transfer, domestic {usd}
Credit limit {usd} to {usd}
Loan amount | {usd} to {usd}
Loan term: {n} to {n} months
Daily ATM limit: {usd}
Daily purchase limit | {usd}
Overdraft fee none
- No monthly fee
- No overdraft fees
- No minimum balance
- No credit check
- Free transfers between your own accounts
- {pct} cash back on groceries
- Earn {pct} back on every purchase
- Early direct deposit
- Instant card lock
- Fixed payments for {n} months
- Round up your change into savings
- Set aside money for {what}
- Pay {who} {where}
- Use it to {do}
- Proof of identity
- A valid Social Security number
- {who} may {do}
There is no charge to {do} {where}.
There is no fee for {what}.
There are no hidden fees and no minimum balance.
We charge {usd} if you {do} {where}.
We may charge {usd} for {what}.
You pay {usd} each month unless you keep a balance of {usd}.
You will be charged {usd} whenever {what} is returned.
A fee of {usd} applies each time you {do}.
A {pct} fee applies to purchases made in another currency.
The monthly fee is waived when you receive {usd} in direct deposits.
The annual percentage yield is {pct} as of {month} {n} and may change at any time.
The APR ranges from {pct} to {pct} and depends on creditworthiness.
Your rate depends on your credit history, income and term.
Rates are variable and can change after the account is opened.
Interest is compounded daily and credited monthly.
Interest accrues from the date of each purchase.
Balances over {usd} earn {pct} per year.
Earn {pct} on savings when you {do}.
The minimum payment is the larger of {usd} or {pct} of the balance.
Payments received after the due date may incur a late charge of up to {usd}.
If you miss a payment, we may report it to the credit bureaus.
If you do not pay on time, your rate may increase.
If you believe there is an error, contact us within {when}.
If your card is lost or stolen, tell us within {when} to limit your liability.
If you {do}, funds arrive within {when}.
You must notify us within {when} after the statement was sent.
You may close your account at any time {where}.
You can {do} {where} with no extra cost.
You can {do} and {do} from {what}.
You agree to {do} only for lawful purposes.
You agree that we may change these terms with {when} notice.
You authorize us to debit your linked account for each payment.
You must be at least 18 years old and a resident of the United States to apply.
Applicants need a valid ID and proof of address.
Applicants with thin credit files may still qualify.
To {do}, open the app and follow the instructions.
To {do}, you need {what} and a government ID.
To apply, {who} need proof of income.
To qualify you must receive direct deposits of at least {usd}.
Once you are approved, the money is sent within {when}.
Transfers are limited to {usd} per day and {usd} per month.
Withdrawals are limited to {usd} a day {where}.
Deposits made before 5 p.m. are available within {when}.
Funds may be held for up to {when} while we verify the deposit.
Mobile deposits are available the next business day.
Direct deposits can arrive up to two days early.
Early repayment carries no penalty.
An early withdrawal penalty applies to the {good}.
A returned payment costs {usd}.
This agreement is governed by the laws of the state of Delaware.
This agreement covers the use of your {good}.
This account is intended for personal use.
Any dispute will be resolved by binding arbitration.
Section {n}. Liability for unauthorized transactions.
Section {n}. You agree to keep {what} secure.
{n}. Changes to this agreement
{n}.{n} The cardholder is responsible for all authorized charges.
We may decline, delay or cancel a transaction that looks unusual.
We may cancel your card without notice if you breach this agreement.
We report your payments to all three credit bureaus each month.
We will mail a new card within {when}.
We will not share {what} with third parties without consent.
We designed the {good} for {who} who want to {do}.
{firm} built the {good} to help {who} {do}.
{firm} helps {who} {do} and {do}.
{nick} lets {who} {do} {where}.
The {good} helps {who} {do}.
The {good} lets you {do} {where} for {usd} a month.
The {good} gives {who} a {how} way to {do}.
The {good} is a {how} account for {who}.
The {good} comes with {what} and no monthly fee.
The {good} was launched in {n} for {who}.
Since {n}, {who} have used the {good} to {do}.
With the {good}, {who} can {do} {where}.
Use the {good} to {do} and {do}.
Designed for {who} who {do} often.
{who} can {do} {where} once {what} is active.
Joint accounts need the consent of both owners.
Points expire after {n} months without activity.
Rewards are credited on the last day of each month.
Purchases of gift cards and cash equivalents do not earn rewards.
The due date falls on the same day every month.
The grace period is at least {n} days after the close of each billing cycle.
The credit line is secured by {what}.
The loan is repaid in equal monthly installments over {n} months.
The card can be used wherever debit cards are accepted.
The card is locked after three wrong PIN entries.
The card may be used at ATMs {where} for {usd}.
Investing involves risk, including loss of principal.
Past performance does not guarantee future results.
Not available in every state.
{firm} is a financial technology company, not a bank.
{firm} is not a bank.
{nick} is a fintech company and does not hold deposits.
Banking services provided by {bank}, Member FDIC.
Banking services are provided by our partner {bank}.
Banking products are offered by {bank}.
The {good} is issued by {bank} under license from Visa.
The {good} is issued by {bank}, Member FDIC, pursuant to a license by Mastercard International.
The {good} is offered through {bank}.
Loans are made by {bank}.
Loans are originated by {bank}, Member FDIC. Equal Housing Lender.
Credit is extended by {bank} subject to approval.
Funds are held at {bank}.
Deposits are held with {bank}, Member FDIC.
Deposits are FDIC insured up to {usd} through {bank}.
Your money is insured up to {usd} by the FDIC through {bank}.
FDIC insurance applies per depositor and ownership category.
FDIC pass-through insurance is subject to conditions being met.
Deposit insurance covers the failure of an insured bank.
Securities are not FDIC insured, not bank guaranteed and may lose value.
{bank}, Member FDIC
Member FDIC. Equal Housing Lender.
Issuer: {bank}
Lender: {bank}
{bank} administers the account and may hold {what}.
{bank} is the issuer of the card and sets its terms.
{bank} may change the terms of {what} at any time.
The lender may check your credit before a loan is funded.
Cookies are baked goods, and bakery purchases count as groceries.
Follow the steps in the app to {do}.
Search fees of {usd} apply when you ask for old statements.
You can log in with a fingerprint to {do}.
Sign up for direct deposit to {do} {where}.
Your right to privacy does not change who may see {what}.
Contact us within {when} if {what} is wrong.
Home equity lines start at {usd}.
All rights under this agreement pass to your heirs.
What you pay
What it costs
What we charge
What {who} get
What {who} owe
What {who} pay each month
Costs at a glance
Cost
Limits and fees
How {who} qualify
Who qualifies
Eligibility and limits
Statement copy / {usd} / month
Paper checks / {usd} / order
Printed statement / {usd}
Card delivery / {usd} / card
{usd} / month
{usd} per month
{usd} per transfer / {usd} per month
{what} / {usd} / month
Plan / price / limit
Item | price
You can sign in with a code; setting up a passkey takes {n} minutes.
Prices above {usd} count toward your rewards.
Search results show only accounts of {who}.
Follow the instructions to {do}.
Accept the card terms before you {do}.
A news alert is sent to {who} when {what} changes.
The community bank that holds the funds may change.
The app works offline for {who} who {do}.
""".strip().split("\n")


def fill(pattern: str, rng: random.Random) -> str:
    s = re.sub(r"\{(\w+)\}", lambda m: rng.choice(SLOTS[m[1]]) if m[1] in SLOTS else m[0], pattern)
    return s[:1].upper() + s[1:] if pattern[:5] in ("{who}",) else s


def lines(copies: int = 24, seed: int = 7, held: bool = False) -> list[tuple[str, int]]:
    """(line, 1 for body and 0 for furniture): each pattern filled `copies` times, a third cut short, some in capitals.

    held: the patterns that are held out, else those that fit.
    """
    rng = random.Random(seed)
    out = []
    for label, patterns in ((0, FURNITURE), (1, BODY)):
        for i, p in enumerate(patterns):
            if (i % 5 == 4) != held:
                continue
            n = copies * (6 if p.startswith("{nav}{sep}") else 1) if "{" in p else max(2, copies // 3)
            for k in range(n):
                s = rng.choice(DECORATION) + fill(p, rng) if k % 4 == 1 else fill(p, rng)
                if k % 3 == 2 and len(s) > 12:
                    s = s[: rng.randint(max(6, len(s) // 4), len(s) - 1)]
                out.append((s.upper() if k % 12 == 5 else s, label))
    return out
