"""Problem 1: template residue, filler, error pages and notices that scripts are needed.

Character n-gram models are fitted for residue (filler, notices, unfilled templates) and for remarks about such things out
of the seed texts below and out of the corpus, and for natural prose and page furniture out of all pages. Each sentence is
a window whose likelihood ratio against prose says what it is. The corpus teaches residue by its structure: windows that
stand on pages of several hosts which have no content beside them, and hardly ever beside content, join the notices; those
that stand beside content as well are furniture. Around placeholders the window is the maximum-scoring stretch. A page is
excluded if a placeholder window stands anywhere in it, or if filler and notices cover the larger part of its sentences.

Results: null and blank texts are no cases and have coverage 0. A coverage of exactly `COVERAGE` excludes. Long texts are
scored whole, window by window.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import code_points, mix64, pieces, total_of
from weir.llm.plain import plain
from weir.session import cut, spread

#: Characters in a gram; slots of the hashed tables.
GRAM, SLOTS = 5, 1 << 17
#: Mass that unseen grams get, as a share of the seen; the same for prose as a number of grams.
UNSEEN, PROSE_UNSEEN = 0.3, 0.02
#: Score (nats) a residue window has at least; share of a page's sentences that residue covers at least.
LEAST, COVERAGE = 18.0, 0.5
#: The same for a placeholder's stretch, which may be a placeholder alone.
LEAST_HOLE = 8.0
#: Score a gram of furniture against prose above which a sentence may be furniture, so that it isn't counted as content.
DOUBT = -2.0
#: Words of a sentence that counts as content; words a sentence of a long line has about, and such sentences on a page with content.
SENTENCE_WORDS, LONG_WORDS, CONTENT = 5, 8, 4
#: Pages without content on which a window stands at least from which the corpus teaches residue and furniture; bits of the filter of such windows.
LEARNED_PAGES, FILTER = 3, 1 << 25
#: Share of a learned window's pages that have content: below the first it is residue, above the second furniture.
RARELY, USUALLY = 0.4, 0.6

HOLE = 10.0
#: Score a gram above which a sentence may be page furniture or a remark, so that it isn't counted as content.
DOUBT = -2.0
#: Words of a sentence that counts as content.
SENTENCE_WORDS = 5

HOLE = "☐"
#: Marks a sentence ends with.
ENDS = frozenset(".।!?…”\"")
#: Placeholders of the usual template languages, and bracketed requests to fill something in.
TOKEN = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|\$\{[^}\n]*\}|#\{[^}\n]*\}|\[\[[^\]\n]*\]\]|%%[\w. -]+%%|@@[\w. -]+@@|__\w[\w.-]*?__|<<[\w. -]+>>|\{[^\W\d][\w. -]*\}|%[A-Z_]{3,}%|\$[A-Z_]{3,}\$"
    r"|&lt;[\w. -]{1,40}&gt;|&lt;%.*?%&gt;"
    r"|[\[<](?:insert|your|enter|add|type|replace|name of|put) [^\]>\n]{1,60}[\]>]|\[[A-Z]{2,}(?:[ _][A-Z]+)*\]|\[यहाँ[^\]\n]*\]",
    re.IGNORECASE | re.DOTALL,
)
DIGITS = re.compile(r"\d+")
#: What stands in every placeholder; of the marks below, at least two do.
OPENING, TWICE = ("{", "[", "<", "@@", "__"), ("%", "$")
DOTTED = re.compile(r"\w[\w-]*(?:\.[\w-]+)+")
#: The end of a sentence, where the next begins.
BREAK = re.compile(r"([.।!?…])\s+")

# Seed texts, written for this purpose: what such pages say in general. A test asserts that no window of them stands in the tables.
FILLER = """
Lorem ipsum dolor sit amet, consectetuer adipiscing elit, sed diam nonummy nibh euismod tincidunt ut laoreet dolore magna aliquam erat volutpat.
Ut wisi enim ad minim veniam, quis nostrud exerci tation ullamcorper suscipit lobortis nisl ut aliquip ex ea commodo consequat.
Duis autem vel eum iriure dolor in hendrerit in vulputate velit esse molestie consequat, vel illum dolore eu feugiat nulla facilisis.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum et dolore.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam eaque ipsa quae ab illo inventore veritatis.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt. Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident, similique sunt in culpa.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae. Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Fusce dapibus, tellus ac cursus commodo, tortor mauris condimentum nibh, ut fermentum massa justo sit amet risus. Integer posuere erat a ante venenatis dapibus posuere velit aliquet. Cras mattis consectetur purus sit amet fermentum. Morbi leo risus, porta ac consectetur ac, vestibulum at eros.
Donec velit neque, auctor sit amet aliquam vel, ullamcorper sit amet ligula. Proin eget tortor risus. Curabitur arcu erat, accumsan id imperdiet et, porttitor at sem.
Vivamus magna justo, lacinia eget consectetur sed, convallis at tellus. Nulla porttitor accumsan tincidunt. Quisque velit nisi, pretium ut lacinia in, elementum id enim.
Nam quam nunc, blandit vel, luctus pulvinar, hendrerit id, lorem. Maecenas nec odio et ante tincidunt tempus. Donec vitae sapien ut libero venenatis faucibus. Augue porta felis mollis massa.
Nullam quis ante. Etiam sit amet orci eget eros faucibus tincidunt. Duis leo. Sed fringilla mauris sit amet nibh. Aenean massa, cum sociis natoque penatibus et magnis dis parturient montes.
Enter your own text here. Put a description of your services here. Type some words about your business into this field. This text is only a placeholder and should be replaced.
Describe your company in two or three lines. Tell your visitors something about yourself here. This is dummy text, please change it before the site goes live. Sample content, to be replaced later. Change this placeholder to a real description of the product. Replace the dummy copy with your own words.
Text to follow. More content is coming soon. To be announced. To be filled in later. TODO write this part. TBD. FIXME. xxx xxxx xx xxxxx xxx. Insert content at this place. Lorem, lorem, lorem.
This is just a test, please ignore this entry. Testing, testing, one two three. Test entry. asdf asdfgh jkl qwertz qwerty. blah blah blah. foo bar baz. Demo text, demo page, demo post.
Welcome to your new blog. This is your very first post; edit or delete it, then begin to write! This is an example of a page, it is different from a post because it will stay in one place and will show up in the menu of your site.
Click on this box to edit the text. Double click to change this heading. Your heading. Your subtitle goes in this line. Add a caption for the picture here. Name of your product goes here.
यस ठाउँमा आफ्नो पाठ लेख्नुहोस्। यो पाठ नमुना मात्र हो, यसलाई पछि बदल्नुहोस्। संस्थाको परिचय यस ठाउँमा लेखिनेछ। सामग्री चाँडै राखिनेछ। आफ्नो शीर्षक यस ठाउँमा राख्नुहोस्। नमुना पाठ हो, कृपया परिवर्तन गर्नुहोस्। यहाँ केही लेख्नुहोस्। विवरण यहाँ आउनेछ।
अपना पाठ इस जगह लिखें। यह केवल नमूना पाठ है, इसे बाद में बदल दें। सामग्री जल्द ही आएगी। संस्था का परिचय यहाँ आएगा। यहाँ अपना शीर्षक डालें।
An dieser Stelle steht später Ihr Text. Dies ist nur ein Blindtext und wird noch ersetzt. Bitte hier eine kurze Beschreibung einfügen. Der Inhalt folgt in Kürze. Beispieltext, bitte ändern.
"""
NOTICE = """
Sorry, the page you requested could not be found. We can't find the page that you are looking for. Error 404: this page cannot be found. The page may have been moved, renamed or deleted. It looks like nothing was found at this location.
HTTP Error 404, file or directory not found. The requested URL /index.html was not found on the server, please check the spelling. The address /a/b does not exist on this server. The link you followed may be broken, or the page may have been removed. Error 410 gone: the resource has been deleted for good and there is no forwarding address. The link is broken and leads to nowhere. Sorry, this page no longer exists. This content was removed by its owner. That page isn't here any more, go back to our home page or try a search. Whoops, nothing to see here.
No results were found for your search. Nothing matched your search terms, please try again with other keywords. There are no posts to show. No entries found.
Error 403: access to this page is forbidden. You don't have permission to access this page on this server. Your access to this site has been denied. Sorry, you have been blocked; you are unable to access this site, request id 7af3. You are not allowed to view this page. Authorization required. This server refused access to the requested resource. You must have an account and be logged in to read this content. Members only: please log in or create an account first. Restricted area. You need to be logged in to see this content. Please sign in again to view this page, your login has expired. Your session timed out, please log on again.
HTTP 500: an internal server error occurred. Sorry, something went wrong on our side while loading this page, our team has been told. The server encountered an unexpected condition and could not complete your request. An error occurred while processing this request, error reference 7af3. Unexpected error, please try again later. Application error: a client-side exception has occurred.
HTTP 502: bad gateway, the upstream server did not respond in time. 504: the gateway timed out. The server is temporarily unable to service your request due to maintenance downtime or capacity problems. This service is temporarily not available, please come back later. 503 error: service is unavailable.
Our website is currently undergoing scheduled maintenance and will be back shortly. Down for maintenance, we will be back in a few minutes. We're improving our site right now, please check again in an hour. We are upgrading our servers, thank you for your patience while we do so. Our systems are being updated; we'll be back online soon. The system will return to normal in a short while. The site is closed for technical work. This website is under construction. The site is offline at the moment.
A database error occurred: could not connect to the database server. There was an error establishing the connection to the database. Warning: mysqli_connect(): access denied for user 'web' in /var/www/html/config.php on line 7. Fatal error: uncaught error: call to undefined function get_header() in /var/www/html/index.php:7. Fatal error: call to a member function fetch() on bool in /home/site/public_html/db.php. Parse error: syntax error, unexpected token in /var/www/html/view.php on line 7.
Unhandled exception: traceback, most recent call last, file "/srv/web/main.py", line 7, in render_page KeyError: 'title'. File "/usr/lib/python/handlers.py", line 7, in get_response. AttributeError: 'NoneType' object has no attribute 'id'. java.lang.NullPointerException at org.example.web.Controller.handle(Controller.java:7). TypeError: cannot read properties of undefined (reading 'length'). Segmentation fault. Out of memory.
This account is suspended, please contact the billing department of your hosting provider. This domain name has expired. The domain is parked and may be for sale. If you are the owner of this website, contact your hosting provider. Success! The web server software is working, but no content has been added yet. Congratulations, your web server is running; this is its default page. If you can read this page, the web server was installed correctly at this host. Index of /pub, parent directory, last modified, size. Too many requests, slow down. This content is no longer available.
This site needs JavaScript to work; please enable it in your browser settings. JavaScript is required to use this application. JavaScript seems to be disabled in your browser. Your browser does not support JavaScript or it is turned off. You must have JavaScript enabled in order to view this website. JavaScript has to be switched on for this site to be displayed correctly. Turn scripting on and reload this page to continue. Sorry, the portal cannot be shown because scripts are blocked; allow scripts for this page. This website does not work properly without scripts. Please switch on scripts and refresh. Page is loading, please wait. One moment, please, we are checking that your browser is secure before you continue. Verifying that you are human, this may take a few seconds. Please turn on JavaScript and cookies and reload the page.
माफ गर्नुहोस्, तपाईंले खोज्नुभएको पृष्ठ भेटिएन। यो पृष्ठ फेला पार्न सकिएन। पृष्ठ हटाइएको वा अन्त सारिएको हुन सक्छ। सर्भरमा प्राविधिक समस्या भयो, कृपया केही समयपछि फेरि प्रयास गर्नुहोस्। वेबसाइट मर्मत भइरहेको छ, असुविधाका लागि क्षमा चाहन्छौँ। यो पृष्ठ हेर्न अनुमति छैन। तपाईंको पहुँच अस्वीकार गरिएको छ। सेवा हाल उपलब्ध छैन।
तपाईंको ब्राउजरमा जाभास्क्रिप्ट बन्द गरिएको छ। यो साइट हेर्न कृपया जाभास्क्रिप्ट सक्रिय गर्नुहोस्। सामग्री हेर्न ब्राउजरको जाभास्क्रिप्ट खोल्नु आवश्यक छ। सामग्री देखाउन मिलेन। डाटाबेससँग जोडिन सकिएन। सर्भरको आन्तरिक त्रुटि भयो। कृपया फेरि लगइन गर्नुहोस्, सत्र सकियो।
maaf garnuhola, tapaile khojnu bhayeko page bhetiyena. yo page fela parena. site marmat bhairahekochha, pachhi pheri aunuhola. kripaya browser ma JavaScript chalu garnuhos. server ma truti bhayo, pheri prayas garnuhos.
क्षमा करें, जो पृष्ठ आप ढूँढ रहे हैं वह नहीं मिला। सर्वर में तकनीकी समस्या है, कृपया कुछ समय बाद फिर प्रयास करें। वेबसाइट का रखरखाव चल रहा है। इस साइट को देखने के लिए जावास्क्रिप्ट चालू करें। आपको इस पृष्ठ को देखने की अनुमति नहीं है।
Die gesuchte Seite konnte leider nicht gefunden werden. Diese Seite existiert nicht oder nicht mehr, nutzen Sie bitte unsere Suche oder gehen Sie zur Startseite. Fehler 404: Seite existiert nicht. Der Zugriff auf diese Seite wurde verweigert. Es ist ein interner Serverfehler aufgetreten. Unsere Website wird gerade gewartet, bitte versuchen Sie es später noch einmal. Zum Anzeigen dieser Seite muss JavaScript in Ihrem Browser aktiviert sein. Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an.
"""
TEMPLATE = """
Dear ☐, thank you for your order of ☐. Dear ☐, we have received your application. Dear ☐ ☐, your account is ready. Dear Mr ☐, Hello ☐, Hi ☐, Good morning ☐! Welcome back, ☐! A warm welcome to ☐ and its team. You are logged in as ☐. Please contact ☐ at ☐ for more information about ☐. Please call ☐ or write to ☐. Written by ☐ on ☐. The report of ☐ was issued on ☐. Published ☐ by ☐. Last changed ☐. Price ☐, date ☐, name: ☐ and address: ☐, phone number: ☐. Invoice ☐ of ☐ is due on ☐. ☐ items in your cart. All rights of ☐ reserved ☐. Your request ☐ has been sent to ☐. Kind regards, ☐ ☐
☐
☐ ☐
☐: ☐
श्री ☐, तपाईंको दरखास्त प्राप्त भयो। प्रिय ☐, धन्यवाद। आदरणीय ग्राहक ☐ ज्यू, कृपया ☐ कार्यालयमा सम्पर्क राख्नुहोला। ☐ को सूचना ☐ गते प्रकाशित भएको हो। नमस्कार ☐ ज्यू। नाम ☐, मिति ☐, ठेगाना ☐, फोन ☐। ☐ मा तपाईंलाई स्वागत छ।
प्रिय ☐, आपका अनुरोध प्राप्त हुआ। ☐ में आपका हार्दिक स्वागत है। Guten Tag ☐, vielen Dank für Ihre Anfrage vom ☐. Liebe Frau ☐, Herzlich willkommen bei ☐.
"""
ABOUT = """
In the programming lesson, pupils write ☐ inside curly braces, and the program puts the value in its place when it prints the page. The tutorial explains what ☐ stands for in a template and how the engine replaces it with the value of a variable.
In this example the variable ☐ is replaced by the name of the reader. A placeholder such as ☐ tells the mail merge where to put the amount that is due before the letter is sent. The course shows beginners why they type ☐ in the source code and what the browser receives instead.
Trainees learned that ☐ in a form letter becomes the sum to be paid. The author writes ☐ between the brackets, then passes the name to the function. The manual says that ☐ must be escaped in the code. Teachers let the class print ☐ first, so that everyone sees how a template is filled in.
Without JavaScript the picture gallery is not shown in your browser, but you can read the whole article. Parts of this page such as the map need JavaScript; all of the text is complete and can be read without scripts. The slideshow is hidden because JavaScript is off.
An exhibition tells how printers filled empty columns with lorem ipsum. The course explains why a web server answers with error 404 when an address is wrong and what a friendly message should say. A study asks how many browsers block scripts for safety. Room 404 is on the fourth floor.
विद्यार्थीले कक्षामा ☐ लेखेर टेम्प्लेटले मान कसरी राख्छ भनी सिके। उदाहरणमा ☐ को ठाउँमा नाम आउँछ भनेर शिक्षकले बुझाए। Im Kurs erklärt die Lehrerin, wofür ☐ in einer Vorlage steht und womit es ersetzt wird.
"""
FURNITURE = """
Jump to the main text. To the top of this page. Sign up for our weekly mail and never miss a story. Follow us for news every day. Tell us what you think about this article. Send this page to a friend. Print this page. Share this story. Read this in another language.
This website uses cookies to give you a better experience. By using this site you agree to our use of cookies. We store small files on your device to remember your settings and to count visits. Accept cookies, refuse, settings, learn more. See our privacy notice.
All content of this site is protected; it may not be copied or republished without our written permission. All rights reserved by the publisher. Website made and maintained by our own team. Terms and conditions, privacy and imprint. Open on weekdays from nine to five. Visitor number 17. Updated on 17 May. Photograph by the author. Read in five minutes.
यस वेबसाइटका सामग्री हाम्रो लिखित स्वीकृति बिना प्रकाशन गर्न पाइँदैन। सर्वाधिकार प्रकाशकमा सुरक्षित छ। यस वेबसाइटले कुकी प्रयोग गर्छ, जसले सेवा राम्रो बनाउँछ। हामीलाई आफ्नो प्रतिक्रिया पठाउनुहोस्। दैनिक समाचारका लागि हामीलाई पछ्याउनुहोस्। यो पृष्ठ साथीहरूसँग बाँड्नुहोस्।
इस वेबसाइट की सामग्री हमारी लिखित अनुमति के बिना प्रकाशित नहीं की जा सकती। यह साइट कुकी का उपयोग करती है। Diese Website verwendet Cookies. Alle Rechte vorbehalten. Nachdruck nur mit schriftlicher Genehmigung.
"""
MODELS = {"filler": FILLER, "notice": NOTICE, "template": TEMPLATE, "about": ABOUT, "furniture": FURNITURE}


def windows(text: str) -> list[str]:
    """The sentences of the lines, lower case, with digits as 0 and placeholders as one mark."""
    text = plain(text)
    if any(mark in text for mark in OPENING) or any(text.count(mark) > 1 for mark in TWICE) or ("&" in text and "&lt;" in text.lower()):
        text = TOKEN.sub(HOLE, text)
    text = BREAK.sub("\\1\n", DIGITS.sub("0", text.lower()))
    return [w for line in text.split("\n") if (w := line.strip())]


@lru_cache(1)
def spelled() -> np.ndarray:
    """For each place in a gram and each character, cut to 16 bits, a part of the gram's slot."""
    x = np.arange(GRAM << 16, dtype=np.uint64)
    return (mix64(x + np.uint64(1 << 40)) & np.uint64(SLOTS - 1)).astype(np.int32).reshape(GRAM, 1 << 16)


def grams(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all grams of the windows, each between two blanks, and where each window's grams begin."""
    points, offsets = code_points([" " + w + " " * (GRAM - 1) for w in group])
    cut = (points ^ (points >> np.uint32(16)) * np.uint32(0x9E37)).astype(np.uint16)
    tables, n = spelled(), max(len(cut) - GRAM + 1, 0)
    slot = tables[0][cut[:n]]
    for k in range(1, GRAM):
        slot ^= tables[k][cut[k : k + n]]
    return slot, offsets


def fitted_from(counts: np.ndarray) -> np.ndarray:
    """Log-likelihoods of grams under the model of windows with these counts of grams."""
    n = max(counts.sum(), 1.0)
    return np.log((np.minimum(counts, 3) + UNSEEN * n / SLOTS) / (n * (1 + UNSEEN))).astype(np.float32)


def fitted_on(group: list[str]) -> np.ndarray:
    """Log-likelihoods of grams under the model of these windows."""
    return fitted_from(np.bincount(grams(group)[0], minlength=SLOTS).astype(np.float64))


def seed_windows(name: str) -> list[str]:
    return [w for line in MODELS[name].strip().split("\n") for w in windows(line)]


@lru_cache(1)
def seeded() -> dict[str, np.ndarray]:
    """The models of the seed texts alone."""
    return {name: fitted_on(seed_windows(name)) for name in MODELS}


def sparse(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["slot", "n"])


def with_content(text: str) -> bool:
    """Whether a page's long lines that end as sentences do hold enough sentences, by their marks and number of words; no model is asked."""
    n = 0
    for line in text.split("\n"):
        words = line.count(" ")
        if words >= LONG_WORDS and line.rstrip()[-1:] in ENDS:
            n += max(1, min(words // LONG_WORDS, line.count(". ") + line.count("। ") + 1))
            if n >= CONTENT:
                return True
    return False


def keyed(window: str) -> str:
    """The window with names of hosts and files masked, so that what differs in them only counts as one."""
    return DOTTED.sub("0", window) if "." in window[:-1] else window


def bare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, host, n): on how many of a task's pages without content of a host a window stands."""
    counts: Counter = Counter()
    for batch in batches:
        for text, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not with_content(text):
                found = windows(text)
                counts.update((w, host) for w in set(map(keyed, found)) if any(map(str.isalpha, w)) and "??" not in w and "�" not in w)
        if len(counts) > 200_000:
            yield counted_rows(counts)
            counts.clear()
    yield counted_rows(counts)


def counted_rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([h for _, h in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["window", "host", "n"])


def bit(window: str) -> int:
    return zlib.crc32(window.encode("utf-8", "surrogatepass")) & (FILTER - 1)


def prose_counts(group: list[str], often: np.ndarray | None = None) -> np.ndarray:
    """Counts of the grams of windows that stand so often (once each if not given).

    Left out are those with placeholders that aren't likelier to be about them, and what the seeds alone find likely.
    """
    own = seeded()
    about = own["about"] - own["template"]
    filler = np.maximum(own["filler"], own["notice"]) - np.maximum(own["about"], np.float32(-np.log(SLOTS)))
    slot, offsets = grams(group)
    lengths = np.diff(offsets)
    lengths[-1] = len(slot) - offsets[-2]
    plainly = np.add.reduceat(filler[slot], offsets[:-1]) <= 0
    for k, w in enumerate(group):
        if HOLE in w:
            plainly[k] = float(about[slot[offsets[k] : offsets[k] + lengths[k]]].sum()) > 0
    kept = np.repeat(plainly, lengths)
    if often is None:
        return np.bincount(slot[kept], minlength=SLOTS)
    return np.rint(np.bincount(slot[kept], np.repeat(often, lengths)[kept], minlength=SLOTS)).astype(np.int64)


def told_rows(rows: Counter, beside: Counter) -> pa.RecordBatch:
    """Rows of windows: how often each stands as it is written, and beside content on how many pages (these without `written`)."""
    keys = [*(k for k, _ in rows), *beside]
    columns = [pa.nulls(len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array([*(w for _, w in rows), *[None] * len(beside)], pa.string()), pa.array([*rows.values(), *beside.values()], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["slot", "window", "written", "n"])


def count_batches(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (slot, window, written, n): counts of the grams of prose by slot, and of the windows that the filter lets pass, which aren't counted as prose."""
    counts = np.zeros(SLOTS, np.int64)
    passed = bits.tobytes()
    rows: Counter = Counter()
    beside: Counter = Counter()
    for batch in batches:
        kept: list[str] = []
        for text in batch.column(0).to_pylist():
            known = set()
            for w in windows(text):
                key = keyed(w)
                h = bit(key)
                if passed[h >> 3] >> (h & 7) & 1:
                    rows[key, w] += 1
                    known.add(key)
                else:
                    kept.append(w)
            if known and with_content(text):
                beside.update(known)
        for group in pieces(kept):
            counts += prose_counts(group)
        if len(rows) > 200_000:
            yield told_rows(rows, beside)
            rows.clear()
            beside.clear()
    yield told_rows(rows, beside)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.string()), pa.array(counts[at], pa.int64())], names=["slot", "window", "written", "n"])


def missed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of prose in windows (written, n) that the filter let pass though no page without content taught them."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        words, often, at = batch.column(0).to_pylist(), batch.column(1).to_numpy(), 0
        for group in pieces(words):
            counts += prose_counts(group, often[at : at + len(group)])
            at += len(group)
    yield sparse(counts)


def taught_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What windows (window, n, beside) teach: counts of grams of prose, after them those of residue, after them those of furniture.

    Windows hardly ever beside content are residue, the others furniture, which counts as prose; what the seeds find likely is no furniture.
    """
    own = seeded()
    seeds = np.maximum(own["filler"], own["notice"]) - np.maximum(np.maximum(own["about"], own["furniture"]), np.float32(-np.log(SLOTS)))
    counts = np.zeros(3 * SLOTS, np.int64)
    for batch in batches:
        for w, n, beside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            share = beside / (beside + n)
            if HOLE in w or RARELY <= share < USUALLY:
                continue
            around = grams([w + " " * GRAM + w[: GRAM - 2]])[0][: len(w) + GRAM]  # with the gap to a window that begins alike
            if share < RARELY:
                np.add.at(counts, SLOTS + around, 1)
            elif seeds[own_slots := grams([w])[0]].sum() < LEAST:
                np.add.at(counts, 2 * SLOTS + around, 1)
                np.add.at(counts, own_slots, beside + n)
    yield sparse(counts)


class Judge:
    """Log-likelihoods of grams under each model, and what they make of a page."""

    def __init__(self, prose: np.ndarray, residue: np.ndarray, furniture: np.ndarray):
        total = max(prose.sum(), 1.0)
        unseen = np.float32(np.log(UNSEEN / (1 + UNSEEN) / SLOTS))  # what no model knows speaks for none
        plainly = np.log((prose + PROSE_UNSEEN) / (total + PROSE_UNSEEN * SLOTS)).astype(np.float32)
        own = seeded()
        notice = np.maximum(own["notice"], fitted_from(residue)) if residue.any() else own["notice"]
        around = np.maximum(own["furniture"], fitted_from(furniture)) if furniture.any() else own["furniture"]
        self.likely = np.stack([own["filler"], notice, np.maximum(plainly, unseen), own["about"], around], 1)
        self.template = own["template"] - np.maximum(plainly, own["about"])

    def pages(self, texts: list[str | None]) -> list[tuple[float, float, float, float]]:
        """Of each text: coverage, score of its best filler, notice and placeholder window."""
        own = [windows(t) if t else [] for t in texts]
        sizes = [len(w) for w in own]
        flat = [w for ws in own for w in ws]
        score = np.zeros((len(flat), 3), np.float32)  # filler, notice and furniture, each against what else the window may be
        holes: dict[int, float] = {}
        at = 0
        for group in pieces(flat):
            slot, offsets = grams(group)
            sums = np.add.reduceat(self.likely[slot], np.minimum(offsets[:-1], max(len(slot) - 1, 0)))
            score[at : at + len(group), :2] = sums[:, :2] - sums[:, 2:].max(1, keepdims=True)
            score[at : at + len(group), 2] = sums[:, 3:].max(1) - sums[:, 2]
            for k, w in enumerate(group):
                if HOLE in w:
                    values = self.template[slot[offsets[k] : offsets[k + 1]]]
                    best = total = 0.0
                    for j in range(len(w) + 1):  # the best stretch that reads a placeholder
                        total = max(0.0, total + float(values[j]))
                        if HOLE in (" " + w)[max(0, j - GRAM) : j + GRAM]:
                            best = max(best, total)
                    holes[at + k] = best
            at += len(group)
        likely = score[:, :2].max(1) > 0 if len(flat) else np.zeros(0, bool)
        ends = np.cumsum(sizes)
        some = np.concatenate([[0], np.cumsum(likely)])
        out = []
        for k, (ws, size) in enumerate(zip(own, sizes, strict=True)):
            begin, end = int(ends[k]) - size, int(ends[k])
            template = max((holes[j] for j in range(begin, end) if j in holes), default=0.0) if holes else 0.0
            if some[end] == some[begin]:
                out.append((0.0, 0.0, 0.0, template))
                continue
            residue = content = 0
            best = np.zeros(2)
            for j in range(begin, end):
                w = ws[j - begin]
                if likely[j]:
                    residue += len(w)
                    top = int(score[j, 1] > score[j, 0])
                    best[top] = max(best[top], score[j, top])
                elif score[j, 2] < DOUBT * len(w) and w[-1:] in ENDS and w.count(" ") + 1 >= SENTENCE_WORDS:
                    content += len(w)
            out.append((residue / max(1, residue + content), float(best[0]), float(best[1]), template))
        return out


def learned(texts: DataFrame) -> DataFrame:
    """(window, n): all windows that stand on enough pages without content, of several hosts, and on how many."""
    each = texts.mapInArrow(bare_batches, "window string, host string, n long").groupBy("window").agg(F.sum("n").alias("n"), F.min(F.coalesce("host", F.lit(""))).alias("low"), F.max(F.coalesce("host", F.lit(""))).alias("high"))
    return cut(each.filter((F.col("n") >= LEARNED_PAGES) & (F.col("low") < F.col("high"))).select("window", "n"))


def filter_of(bare: DataFrame) -> np.ndarray:
    """A bit for each hash of a window, 64 to a number; its size is fixed, it lets all of these windows pass and few others."""
    hashed = bare.select(F.crc32("window").bitwiseAND(F.lit(FILTER - 1)).alias("h"))
    out = np.zeros(FILTER // 64, np.int64)
    for row in hashed.groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toLocalIterator():
        out[row[0]] = row[1]
    return out


def fitted(pages: DataFrame) -> Judge:
    """The models of all texts and of all windows that the corpus teaches; what comes to the driver has a fixed size.

    The pages are read past the filter; windows that pass it are looked up among the taught ones, and the few that aren't
    there are counted as the prose they are.
    """
    texts = spread(pages.select("text", "host").filter("text IS NOT NULL"))
    bare = learned(texts)
    shared = pages.sparkSession.sparkContext.broadcast(filter_of(bare))
    counted = texts.mapInArrow(lambda batches: count_batches(batches, shared.value), "slot int, window string, written string, n long")
    both = cut(counted.groupBy("slot", "window", "written").agg(F.sum("n").alias("n")))
    beside = both.filter("window IS NOT NULL AND written IS NULL").select("window", F.col("n").alias("beside"))
    taught = bare.join(beside, "window", "left").select("window", "n", F.coalesce("beside", F.lit(0)).alias("beside"))
    missed = both.filter("written IS NOT NULL").join(bare, "window", "left_anti").select("written", "n")
    slots = both.filter("slot IS NOT NULL").select("slot", "n").unionByName(taught.mapInArrow(taught_batches, "slot int, n long")).unionByName(missed.mapInArrow(missed_batches, "slot int, n long"))
    total = total_of(slots, "n", 3 * SLOTS)
    return Judge(total[:SLOTS], total[SLOTS : 2 * SLOTS], total[2 * SLOTS :])


def scored(pages: DataFrame) -> DataFrame:
    """(id, coverage, filler, notice, template) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(fitted(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                values = np.array(judge.pages(part.column(1).to_pylist()), np.float32).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(values[:, k]) for k in range(4))], names=["id", "coverage", "filler", "notice", "template"])

    return spread(pages.select("id", "text")).mapInArrow(run, "id long, coverage float, filler float, notice float, template float")


def excluded(pages: DataFrame) -> DataFrame:
    """(id, coverage, kind) of the pages that don't hold what they should."""
    kind = F.when(F.col("template") >= LEAST_HOLE, "placeholder").when((F.col("coverage") >= COVERAGE) & (F.greatest("filler", "notice") >= LEAST), F.when(F.col("filler") >= F.col("notice"), "filler").otherwise("notice"))
    return scored(pages).withColumn("kind", kind).filter("kind IS NOT NULL").select("id", "coverage", "kind")
