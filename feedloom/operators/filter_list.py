"""The default cleaning filters, in order.

Each entry is (kind, options...). Patterns are in Python's dialect;
:mod:`feedloom.operators.cleaning` turns them into Java's.

    ("strip", pattern, flags, replacement, repeat)
    ("link", template, pattern on link, pattern on content)
    ("title", template, pattern on content, flags)
    ("first_link", link prefix)
    ("dereference", link part, pattern on page)
    ("limit", link part, filter)

Flags: i = ignore case, m = multi-line anchors, s = dot matches newline.
"""

from __future__ import annotations


def strip(pattern: str, flags: str = "", sub: str = "", repeat: bool = False) -> tuple:
    return ("strip", pattern, flags, sub, repeat)


# --- fixed values: what is removed or rewritten, and in which order -----------
DEFAULT_FILTERS: list[tuple] = [
    strip(r'(<br\s+[^>]*>)', "", "<br>"),
    # share-this links
    strip('<a href="http://www.bloglines.com/sub/.*?</a>'),
    strip('<a href="http://del.icio.us/post.*?</a>'),
    strip('<a href="http://digg.com/submit.*?</a>'),
    strip('<a href="http://www.furl.net/storeIt.jsp.*?</a>'),
    strip('<a href="http://ma.gnolia.com/bookmarklet/add.*?</a>'),
    strip('<a href="http://www.propeller.com/submit.*?</a>'),
    strip('<a href="http://reddit.com/submit.*?</a>'),
    strip(r'<a href="http://www.sphere.com/search\?q=sphereit.*?</a>'),
    strip('<a href="http://www.stumbleupon.com/submit.*?</a>'),
    strip('<a href="http://tailrank.com/share/.*?</a>'),
    strip(r'<a href="http://technorati.com/faves\?add.*?</a>'),
    strip('<a href="http://www.feedburner.com/fb/a/emailFlare.*?</a>'),
    strip('<a href="http://slashdot.org/bookmark.pl.*?</a>'),
    strip('<a href="http://www.facebook.com/sharer?.php.*?</a>'),
    strip('<a href="http://www.google.com/bookmarks/mark.*?</a>'),
    strip('<a href="http://blinklist.com.*?</a>'),
    strip('<a href="http://del.irio.us.*?</a>'),
    strip('<a href="http://www.kaboodle.com.*?</a>'),
    strip('<a href="http://www.newsvine.com.*?</a>'),
    strip('<p class="addtoany_.*?</p>', "ms"),
    strip('<a[^>]*href="[^"]*addtoany.com.*?</a>', "ms"),
    strip('<div class="social_bookmark">.*?</div>', "ms"),
    strip(r'<a href="http://www.pheedcontent.com.*?</a>\s*'),
    strip('<div class="zemanta.*?</div>', "ms"),
    strip('<p>Follow us on Twitter.*?</p>', "msi"),
    strip('<div class="tweetmeme_button".*?</div>', "msi"),
    strip('<p><a href="[^"]*sharethis.com.*?</p>', "msi"),
    strip('<a href="[^">]*.tweetmeme.com.*?</a>', "msi"),
    strip('<a [^>]* href="http://twitter.com/home/[?]status.*?</a>', "msi"),
    strip('<a [^>]*feedblitz.com.*?</a>', "msi"),
    # feed host trackers
    strip('<a href[^>]*><img src="http://feeds.feedburner[^>]*></a>'),
    strip(r'<p><a href="(http://feeds\.[^"/>]*/~./)[^"]*"><img src="\1[^>]*></a></p>'),
    strip('<img src="http://feeds.feedburner.com.*?/>'),
    strip(r'<div>\s*<a href="[^"]*/~ff/.*?</div>', "si"),
    # one-pixel images
    strip('<img[^>]*width="1"[^>]*height="1"[^>]*>'),
    strip('<img[^>]*height="1"[^>]*width="1"[^>]*>'),
    strip('<img[^>]*width="0"[^>]*height="0"[^>]*>'),
    strip('<img[^>]*height="0"[^>]*width="0"[^>]*>'),
    # advertisements
    strip('(<p>)?<a[^>]*href="http://[a-z]*ads.googleadservices[^>]*>[^<>]*<img [^<>]*></a>(</p>)?', "m"),
    strip('<a[^>]*href="http://www.google.com/ads_by_google[^>]*>[^<>]*</a>', "m"),
    strip('<p><map[^>]*><area[^>]*href="http://imageads.google.*?</p>', "m"),
    strip('<img[^>]*src="http://feeds.wordpress[^>]*>'),
    strip(r'<div><br>\s*<strong>.*?<a href="[^"]*falkag.net[^>]*>.*?</strong><br>.*?</div>', "si"),
    strip('<a href="[^"]*falkag.net[^>]*><img[^>]*></a>'),
    # spacers in front of advertisements
    strip('<p>&#160;</p>'),
    strip(r'<p><br />\s*</p>\s*', "m"),
    strip(r'\s*(<br>)?<p>\s*<br>\s*</p>\s*', "m"),
    # more advertisements, forms and footers
    strip('<a[^>]*href="http://ad.doubleclick.net[^>]*>.*?</a>', "m"),
    strip('<p>ADVERTISEMENT.*?</p>'),
    strip('<p class="adv">.*?</p>'),
    strip('<div.*<img[^>]*commindo-media.*?</div>', "ms"),
    strip('<form.*?</form>', "si"),
    strip('<p><a[^>]*href="http://feeds.gawker.com[^>]*>[^<>]*<img [^>]*src="http://feeds.gawker.com[^<>]*></a></p>', "m"),
    strip(r'<h([0-9])></h\1>'),
    strip('<a href=[^>]*>Permalink</a>.*?<a [^>]*>Email this</a>.*?Comments</a>', "si"),
    strip('<p><font size="1"><hr />SPONSORED BY.*?</p>'),
    strip(r'<hr /><p>SPONSORED BY.*?</p>\s*', "m"),
    strip('<p.*?originally appeared on.*?terms for use of feeds.*?</p>', "m"),
    strip(r'&nbsp;<br><a href=[^>]*>Comment on this post</a>\s*<br>Related.*', "si"),
    strip('<div class="feedflare">.*?</div>', "si"),
    strip('<div class="mf-related"><p>Articles en rapport.*</div>', "si"),
    strip('<div style="font-size: xx-small; color: gray; padding-bottom:0.5em;">Presented By:</div>'
          '[^<>]*<div><a href="http://ads.pheedo.*?</div>.*?</div>', "ms"),
    strip('<a[^>]*href="http://[^">]*pheedo.com.*?</a>', "ms"),
    strip('<img[^>]*src="http://[^">]*pheedo.com.*?>', "ms"),
    ("link", r'http://pheedo.com\1', r'http://www.pheedo.com(.*)', None),
    strip('(<br>)*<img[^>]*triggit.com.*?>', "ms"),
    strip('<img[^>]*quantserve.com.*?>', "ms"),
    strip('<img [^>]*invitemedia.com[^>]*>', "msi"),
    strip('<br><a[^>]* href="?http://[^"]*.feedsportal.com.*?</a>', "ms"),
    # links that should lead to the article itself
    ("link", r'http://www.idfuel.com/index.php?p=\1&more=1', r'http://www.idfuel.com/index.php\?p=([0-9]*)', None),
    ("link", r'\1', r'http://go.theregister.com/feed/(http://.*)', None),
    ("link", r'http://www.pbs.org/cringely/\1', r'http://www.pbs.org/cringely/rss1/redir/cringely/(.*)', None),
    strip('<strong>Advertisement</strong><br>'),
    strip('<p><a[^>]*href="http://whitepapers.theregister.co.uk.*?</p>', "m"),
    strip('<div class="mf-viral">.*</div>'),
    strip('<p>.*?feediz.com.*?</p>', "ms"),
    strip('<a [^>]*feediz.com.*?</a>', "ms"),
    strip('<p><a href="http://feeds.salon.com/~a[^>]*><img [^>]*></a></p><img[^>]*>'),
    strip('<p align="right" class="ad">.*?</p>'),
    ("dereference", 'digg.com', '<h3 id="title1"><a href="([^"]*)"'),
    strip('<a href="http://[^"]*doubleclick.*?</a>', "ms"),
    strip('<p class="akst_link">.*?</p>', "ms"),
    ("first_link", 'http://www.pythonware.com/daily/'),
    ("title", r'\1', '<div class="description">.*?<a href=.*?>(.*?)</a>', "ms"),
    ("first_link", 'http://evanmiller.org/'),
    strip('<p><small>[^<>]*<a href="http://www.theinquirer.net[^<>]*><i>[^<>]*Read the full article.*', "ms"),
    strip('<p><small>[^<>]*<a href="http://www.theinquirer.net.*?<i>', "m"),
    strip('<p><em><strong>Hide Your Shame:</strong> The A List Apart Store.*?</p>', "ms"),
    strip('<p>.*<a href="http://www.beyondsecurity.com.*?</p>', "ms"),
    strip('<fieldset class="zemanta-related">.*?</ul>', "ms"),
    # leftovers: stray breaks, empty elements
    strip('<br>[.>]<br>', "", "<br>", repeat=True),
    strip(r'<br>\s*(<br>\s*)+', "", "<br>"),
    strip('<p>&nbsp;</p>'),
    strip('<p [^>]*></p>'),
    strip('<p>-</p>'),
    strip('<span[^>]*></span>', "", "", repeat=True),
    strip('<strong></strong>'),
    strip(r'(<br>\s*)+$'),
    strip(r'-\s+(-\s+)+'),
    # single sites
    strip('<img[^>]*src="http://stats.wordpress.com.*?>'),
    strip(r'\s*<hr[^>]*>\s*<p>\s*<a href="http://t.gigaom.com/.*?</p>', "ms"),
    strip(r'<hr\s?/?>\s*<a href="http://events.gigaom.com/.*</a>', "ms"),
    strip(r'<hr\s?/?>\s*<a href="http://pro.gigaom.com/.*</a>', "ms"),
    strip(r'\s*<hr[^>]*>\s*<p>\s*<a href="http://gigaom.com/sponsor.*?</p>', "ms"),
    strip(r'\s*<hr[^>]*>\s*<p>\s*<a href="http://ads.gigaom.com.*?</p>', "ms"),
    strip('<div class="related" style="float.*?</div>', "ms"),
    strip('<div class="relatedinfo".*?</div>', "ms"),
    strip('<a [^>]* title="Click here to continue reading.*?</a>', "ms"),
    strip('<a href="http://arstechnica.com[^>]*>[^<>]*<img [^>]*brief_icons.*?</a>', "ms"),
    strip(r'<table>.*?\[advertisement\].*?</table>', "ms"),
    strip('<p><span[^>]*><strong>Get Fooducated.*?</p>', "ms"),
    strip('<p>[^>]*<a href="http://alpha.fooducate.com.*?</p>', "ms"),
    strip('<p align="right"><em>Sponsor</em><br>.*?</p>', "ms"),
    strip(r'<p><hr />\s*<p>\s*<a href="http://laughingsquid.us/">.*?Laughing Squid Web Hosting</a>.</p></p>', "ms"),
    strip('<table.*?feedblitz.com.*?</table>', "ms"),
    ("link", r'http://m.xkcd.com\1', r'http://xkcd.com(.*)', None),
    strip('<figure.*?https://cdn-images-1.medium.com/max/700/1*PZjwR1Nbluff5IMI6Y1T6g@2x.png.*?</figure>', "ms"),
    strip('<p>.*?on Medium, where people are continuing the conversation by highlighting and responding to this story.*?/p>', "ms"),
    strip('<p align=center><a href="http://dynamic[^"]*.anandtech.com/www/delivery/.*?</[ap]>', "ms"),
    strip("<p align=center><a href='http://dynamic[^']*.anandtech.com/www/delivery/.*?</[ap]>", "ms"),
    ("limit", 'techradar.com', strip('<div class="product".*?</div>', "ms")),
]
# ------------------------------------------------------------------------------
