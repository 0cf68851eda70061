"""Literal rows that queries run on where the tables hold nothing of the kind."""

#: name, texts of one account, parent text.
SIGNAL_TEXTS = [
    ("support", ["Your account is locked. Kindly contact our support on Telegram: @helpdesk immediately"], "My wallet app crashed today"),
    ("airdrop", ["HURRY the airdrop ends today only, connect your wallet at www.claim-now.xyz 🚀🚀🚀"], "Release notes for version two"),
    ("thread", ["I tested forty tools so you don't have to 🧵 1/10 https://bit.ly/abc"], "Tools for writers"),
    ("ordinary", ["The index rebuild took nine minutes on our cluster, mostly sorting."], "How long do your index rebuilds take?"),
    ("offtopic", ["Best shoes here shoes-shop.com/sale"], "Quarterly earnings were strong"),
    ("profit", ["Thanks to @mentorpro, I made $12,000 in 7 days. Guaranteed returns!"], "Morning everyone"),
    ("job", ["Work from home, earn $300 per day, no experience needed. Comment Interested #Interested"], None),
    ("adult", ["lonely tonight, check my bio 🔞"], None),
    ("bio", ["new drawing posted, link in bio"], None),
    ("follow", ["follow for follow! I follow back everyone #f4f"], None),
    ("praise", ["Great insights, thanks for sharing!", "So true, love this"], "We moved to partial indexes"),
    ("specific", ["Thanks for sharing, the partial index tip saved our migration weekend"], "We moved to partial indexes"),
    ("milestone", ["Happy to announce I completed the cloud architect certification #certified"], None),
    ("advert", ["Book a demo and sign up for our free webinar, 50% off, link in comments #ai #growth #saas"], None),
    ("ai", ["Let's dive in. This game-changer is a testament to leveraging transformative tools — crucial and seamless. " + "word " * 60 + "\n1. First\n2. Second"], None),
    ("caps", ["WHY IS NOBODY TALKING ABOUT THIS AMAZING THING RIGHT NOW"], "talking about this"),
    ("empty", [""], "something"),
]

URLS = [
    "https://x.com/jane/status/1234567890?s=20", "http://mobile.twitter.com/Jane_1/status/99", "https://www.x.com/home", "x.com/home",
    "https://twitter.com/", "https://www.linkedin.com/feed/", "https://linkedin.com", "https://www.linkedin.com/in/jane-doe/",
    "https://www.linkedin.com/feed/update/urn:li:activity:7123456789012345678/", "https://www.linkedin.com/posts/jane_topic-activity-7123456789012345678-Ab_c?utm=1",
    "https://www.linkedin.com/company/acme%20labs/", "https://x.com/i/flow/login", "https://x.com/login?next=1", "https://www.linkedin.com/authwall?x=1",
    "https://www.linkedin.com/uas/login", "https://example.com/x.com/jane/status/1", "", "  https://x.com/a/status/5  ",
]

#: id, relative label.
TIMES = [
    ("7123456789012345678", None), ("7123456789012345678", "3h"), ("12", "3h"), (None, "2d"), (None, "4mo"), (None, "1yr"), (None, "1y ago"), (None, "15 m"),
    (None, "soon"), (None, None), ("abc", "1w"), ("99999999999999999", "30s"),
]

#: analysis_id, created (seconds), demo, running.
ANALYSES = [(f"{i:032x}", 1_700_000_000 + 60 * (i * 7 % 45), i % 11 == 0, i % 13 == 0) for i in range(45)]

GRAPH_NAMES = ["lens_" + "ab" * 16, "lens_" + "AB" * 16, "lens_short", "other_" + "ab" * 16, "lens_" + "0f" * 16]

#: conv_id, seq, focal, id, handle, text, seconds.
SCANS = [
    ("t1", 0, True, "p", "Root", "", 100), ("t1", 1, False, "a", "Ann", "first", 130), ("t1", 2, False, "b", "Bob", "", 131), ("t1", 3, False, "p", "Root", "the post", 100),
    ("t1", 4, True, "p", "Root", "the post", 100), ("t1", 5, False, "a", "Ann", "changed", 130), ("t1", 6, False, "b", "bob", "later", 131), ("t1", 7, False, "c", "ANN", "early", 90),
    ("t2", 8, True, "q", "Sue", "other post", 50), ("t2", 9, False, "d", "Dan", "hello", 60), ("t2", 10, False, "d", "Dan", "hello", 60),
]

X_PAGE = """<div><article data-testid="tweet"><a href="/old/status/1"><time datetime="2024-01-01T00:00:00.000Z"></time></a>
<div data-testid="tweetText">An ancestor</div></article>
<article data-testid="tweet"><a href="/root/status/10"><time datetime="2024-01-02T00:00:00.000Z"></time></a>
<div data-testid="tweetText">The <b>post</b></div></article>
<article data-testid="tweet"><div data-testid="tweetText">Promoted, no link</div></article>
<article data-testid="tweet"><a href="/ann/status/11"><time datetime="2024-01-02T00:01:00.000Z"></time></a>
<div role="link"><div data-testid="tweetText">quoted</div></div><div data-testid="tweetText">A reply</div></article>
<article data-testid="tweet"><a href="/bob/status/12"><time datetime="2024-01-02T00:02:00.000Z"></time></a></article></div>"""

LINKEDIN_PAGE = """<div data-urn="urn:li:activity:7123456789012345678"><a class="update-components-actor__meta-link" href="/in/jane-doe">Jane</a>
<div class="update-components-text">The post</div>
<article data-id="urn:li:comment:(activity:7123456789012345678,7123456799012345678)"><a href="/in/ann">Ann</a>
<div class="update-components-text">Top comment</div>
<article data-id="urn:li:comment:(activity:7123456789012345678,7123456809012345678)"><a href="/company/acme">Acme</a>
<div class="update-components-text">Nested</div></article></article></div>"""

LINKEDIN_FEED_PAGE = """<div data-urn="urn:li:activity:7123456789012345678"><a class="update-components-actor__meta-link" href="/in/outer">Outer</a>
<div class="update-components-text">Repost</div><div data-urn="urn:li:activity:7123456789012345000"><div class="update-components-text">inner</div></div></div>
<div role="listitem" componentkey="update-card-focusKEY-1"><p>Sam likes this</p><a href="/in/bea"><span>Bea</span></a><span>3h</span>
<div data-testid="expandable-text-box">New layout</div></div>
<div role="listitem" componentkey="update-card-focusKEY-2"><a href="/company/ads"><span>Ads</span></a><span>Promoted</span>
<div data-testid="expandable-text-box">Buy</div></div>"""

PAGES = [
    ("x", "x_thread", "10", X_PAGE), ("xf", "x_feed", None, X_PAGE), ("l", "linkedin_thread", "7123456789012345678", LINKEDIN_PAGE),
    ("lf", "linkedin_feed", None, LINKEDIN_FEED_PAGE), ("none", "x_thread", "999", "<p>nothing</p>"),
]
