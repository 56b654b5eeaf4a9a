"""Pages labelled by hand, for shapes that a table may lack.

Fixed values: ``data-c`` marks what is the main text (1) and what inside or beside
it is not (0); the extractor never reads it as a feature. All else is neither.
"""

_LONG = "The river rose twice that spring, and each time the lower fields went under water. Nobody moved the cattle in time, so the losses were heavy."
_MORE = "By the middle of the month the road was open again. Most families came back, although some of the houses could not be lived in before summer."
_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul>'

PAGES = [
    f'<html><head><title>A</title></head><body><header class="site-header"><a href="/">Daily Paper</a><p>News since 1901.</p></header><nav class="main-menu">{_MENU}</nav><main><article data-c="1"><h1>The flood</h1><p>{_LONG}</p><h2>After it</h2><p>{_MORE}</p><p>It is over.</p></article></main><aside class="sidebar"><h3>Most read</h3>{_MENU}<p>Sign up for our letter. It comes every week.</p></aside><footer><p>&copy; Daily Paper. All rights reserved.</p></footer></body></html>',
    f'<html><body><div id="header"><h2>My blog</h2>{_MENU}</div><div id="wrapper"><div id="content"><div class="post" data-c="1"><h1>Bread</h1><p>{_MORE}</p><blockquote><p>{_LONG}</p></blockquote><ul><li>Two cups of flour.</li><li>Salt</li></ul><p>{_MORE}</p></div><div id="comments" class="comments"><h3>3 comments</h3><div class="comment"><p>I tried this and it worked well, thank you.</p></div><div class="comment"><p>Mine did not rise. What did I do wrong?</p></div><form class="comment-form"><label>Name</label><p>Leave a reply</p></form></div></div><div id="sidebar" class="widget-area"><div class="widget"><h4>Archive</h4>{_MENU}</div><div class="widget"><p>About the author. She writes about food.</p></div></div></div><div id="footer"><p>Powered by a blog engine. Privacy policy.</p></div></body></html>',
    f'<html><body><div class="cookie-notice"><p>We use cookies to improve your visit. By going on you agree to our terms.</p></div><div class="top-banner ad"><p>Buy one, get one free. Only today!</p></div><div class="page"><div class="breadcrumb"><a href="/">Home</a> <a href="/x">Travel</a></div><div class="entry-content" data-c="1"><h1>Walking north</h1><p>{_LONG}</p><div class="ad-slot" data-c="0"><p>The best boots you will ever own. Order them now.</p></div><p>{_MORE}</p><div class="share-buttons" data-c="0"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{_LONG}</p></div><div class="related"><h3>You may like</h3><ul><li><a href="/1">Ten walks in the hills</a></li><li><a href="/2">What to pack</a></li></ul></div></div></body></html>',
    f'<html><body><table><tr><td class="menu">{_MENU}</td><td data-c="1"><h2>Minutes of the meeting</h2><p>{_MORE}</p><table><tr><th>Item</th><th>Vote</th></tr><tr><td>Budget</td><td>Passed</td></tr></table><p>{_LONG}</p></td></tr></table><p>Last changed on Monday. Send mail to the editor.</p></body></html>',
    f'<html><body><div><div>{_MENU}</div><div data-c="1"><h1>On rain</h1><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p></div><div><p><a href="/prev">Previous</a> <a href="/next">Next</a></p><p>Copyright, all rights reserved</p></div></div></body></html>',
    f'<html><body><div role="banner"><p>The Society</p></div><div role="navigation">{_MENU}</div><section><header><h4>Section of letters</h4></header><article data-c="1"><header data-c="0"><p>Posted by Ann in March</p></header><h1>A letter</h1><p>{_MORE}</p><figure><figcaption>The house in winter.</figcaption></figure><p>{_LONG}</p><aside data-c="0"><p>Read also: another letter.</p></aside><pre>one\n two</pre><footer data-c="0"><p>Filed under letters</p></footer><section class="comments" data-c="0"><h2>Readers say</h2><article class="comment"><p>{_LONG}</p></article><article class="comment"><p>{_MORE}</p></article></section></article></section><div class="newsletter"><form><p>Your address</p></form></div><div class="modal popup" style="display:none"><p>Do not go yet. Take ten percent off your first order.</p></div></body></html>',
    f'<html><body><div class="notice"><p>This site is moving. Please read the notice.</p></div><nav><ol><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ol></nav><div class="story-body" data-c="1"><p>{_LONG}</p><p>{_MORE}</p><h3>Why</h3><p>{_LONG}</p><dl><dt>Flood</dt><dd>Water where there should be none.</dd></dl></div><div class="promo sponsored"><h3>Sponsored</h3><p>A bank you can trust. Open your account in five minutes.</p></div><div class="author-bio"><p>He is a reporter. He lives by the sea.</p></div><footer><ul><li><a href="/imprint">Imprint</a></li><li>Tel. 123</li></ul></footer></body></html>',
    f'<html><body><p><a href="/">Index</a> | <a href="/up">Up</a></p><div data-c="1"><h1>Chapter one</h1><p>{_LONG}</p><p>Yes.</p><p>{_MORE}</p><p>{_LONG}</p><hr><p>{_MORE}</p></div><form><p>Search this book</p></form></body></html>',
    f'<html><body><nav>{_MENU}</nav><article data-c="1"><h1>Short note</h1><p>{_LONG}</p><aside data-c="0"><p>{_MORE}</p></aside><form data-c="0"><label>Mail</label><p>Tell us what you think of it.</p></form></article><footer><p>Contact. Imprint.</p></footer></body></html>',
    f'<html><body><header><h1>The Gazette</h1><p>{_LONG}</p></header><article data-c="1"><p>{_MORE}</p><nav data-c="0"><ol><li><a href="#a">Part one</a></li><li><a href="#b">Part two</a></li></ol></nav><h2>Part one</h2><p>{_LONG}</p><div class="sponsored" data-c="0"><p>{_LONG}</p></div><ul><li>A boat, which we hired.</li><li>Bread and salt.</li><li>Rope</li></ul><p>Done.</p><section class="comments" data-c="0"><h3>Comments</h3><p>{_MORE}</p><p>Me too!</p></section></article></body></html>',
    f'<html><body><main data-c="1"><h1>Soup</h1><p>{_MORE}</p><h2>You need</h2><ol><li>Onions</li><li>One litre of water.</li><li>Salt</li></ol><h3>Then</h3><p>{_LONG}</p><aside class="widget" data-c="0"><h3>Newsletter</h3><p>{_LONG}</p></aside><div class="share" data-c="0"><a href="#">Share</a></div><p>Serve.</p><form data-c="0"><p>Rate this. Did you like it?</p></form></main><aside><h4>More soups</h4><p>{_MORE}</p></aside><footer><p>{_LONG}</p></footer></body></html>',
    f'<html><body><div class="cookie-consent"><p>{_MORE}</p></div><article data-c="1"><h1>One thing</h1><p>Only this.</p><div class="advert" data-c="0"><p>{_MORE}</p></div></article><div id="comments" class="comments"><p>{_LONG}</p><div class="comment"><p>{_MORE}</p></div></div><div class="footer"><p>{_LONG}</p></div></body></html>',
    f'<html><body><article data-c="1"><p>{_MORE}</p><section class="replies" data-c="0"><h2>Replies</h2><p>{_LONG}</p></section></article></body></html>',
    f'<html><body><article data-c="1"><p>{_LONG}</p><form data-c="0"><p>Leave your address, and we will write to you.</p></form><div class="related" data-c="0"><p>{_MORE}</p></div></article><nav>{_MENU}</nav></body></html>',
]
