"""Labelled pages for the scores of ``html_text``: what stands before the content, the content, what stands after it."""

_P = "<p>The council met on Tuesday to discuss the new bridge, and members agreed that work should begin before the winter sets in.</p>"
_Q = "<p>Engineers had warned for years that the old crossing, built when carts were common, could not bear the weight of modern lorries for much longer.</p>"
_L = "<ul><li>The first lane opens in May, once the supports have been checked.</li><li>The second lane follows in June, if the weather allows it.</li></ul>"
_QUOTE = "<blockquote><p>We have waited a long time for this, and we will not wait any longer than we must.</p></blockquote>"
_TABLE = "<table><tr><th>Year</th><th>Traffic</th></tr><tr><td>1990</td><td>four thousand carriages a day</td></tr></table>"
_HEAD = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Bridge to open in spring - The Daily</title><style>p{margin:0}</style><script>track(1);</script></head><body>'
_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About us</a></li></ul></nav>'
_LINKS = '<ul><li><a href="/a">Ten things to do</a></li><li><a href="/b">Old maps of the town</a></li><li><a href="/c">Letters</a></li></ul>'
_AD = '<div class="ad">Buy two pairs of shoes today and get the third for nothing.</div>'
_COOKIE = '<div class="cookie-notice">We use cookies to improve your visit. <button>Accept all</button></div>'
_FORM = '<form action="/s"><label>Search the site</label><input name="q"><button>Go</button></form>'
_SIDE = '<aside><h3>Most read</h3><ul><li><a href="/x">Storm warning for the coast</a></li><li><a href="/y">School opens new hall</a></li></ul></aside>'
_COMMENTS = '<section class="comments"><h3>Comments</h3><p>Great news, I drive there every day!</p><p>About time, they should have done it ten years ago.</p></section>'
_FOOT = '<footer><p>&copy; 2024 The Daily. All rights reserved.</p><a href="/terms">Terms</a> <a href="/privacy">Privacy</a></footer></body></html>'

_MANY = "<p>Read more in our series: " + " ".join(f'<a href="/s/{i}">part {i} of the bridge story</a>' for i in range(20)) + "</p>"
_DL = "<dl><dt>Length</dt><dd>four hundred metres from bank to bank</dd><dt>Height</dt><dd>thirty metres above the water</dd></dl>"
_FIGURE = "<figure><img src='b.jpg' alt='bridge'><figcaption>The old crossing in the summer of last year</figcaption></figure>"
_FORUM = '<div class="reply"><b>anna</b> I do not believe a word of it.</div><div class="reply"><b>ben</b> Wait and see what happens then.</div>'
_CRUMBS = '<div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/news">News</a> &gt; Bridge</div>'
_SHARE = '<div class="share"><a href="#">Share</a> <a href="#">Tweet</a> <a href="#">Mail</a></div>'
_PLAIN = "<div>Some people said that nobody would ever cross it.<br>Others said that they would cross it every single day.</div>"

PAGES = [
    (_HEAD + _NAV + _AD + "<article>", "<h1>Bridge to open in spring</h1>" + _P + _Q + _L + _P, "</article>" + _SIDE + _FOOT),
    (_HEAD + '<header><a href="/">The Daily</a> <span>News every day</span></header>' + _NAV + "<main>", "<h1>Bridge to open</h1><h2>Winter work</h2>" + _P + _QUOTE + _Q, "</main>" + _COMMENTS + _FOOT),
    (_HEAD + _COOKIE + _NAV + '<div id="content">', "<h1>A bridge at last</h1><p>" + "We drove out to see it, <a href='/m'>the new crossing</a>, on a bright morning.<br>The river was high.</p>" + _Q + _TABLE + _P, "</div>" + _FORM + _SIDE + _FOOT),
    (_HEAD + '<div class="masthead">The Daily, since 1890</div><div class="menu">' + _LINKS + "</div><div><div>", _P + _P + "<h3>What comes next</h3>" + _Q, "</div></div><div>" + _LINKS + "</div>" + _COMMENTS + _FOOT),
    (_HEAD + _NAV + _FORM + _AD + "<article>", "<h1>Bridge</h1><p>It opened.</p>", "</article>" + _AD + _LINKS + _FOOT),
    ("<html><body><div>" + _LINKS + "</div>", "<div>The council met on Tuesday to discuss the new bridge.<br><br>Members agreed that work should begin before the winter.</div><pre>lane 1: May\nlane 2: June</pre>", "<div>" + _LINKS + "</div></body></html>"),
    (_HEAD + _CRUMBS + '<div class="layout with-sidebar">', "<h1>Bridge in numbers</h1>" + _P + _DL + _FIGURE + _Q, "</div>" + _SHARE + _SIDE + _FOOT),
    (_HEAD + _NAV + "<article>", "<h1>All the parts</h1>" + _P + _MANY + _TABLE + _Q, "</article><h3>What readers say</h3>" + _PLAIN + _FOOT),
    (_HEAD + _LINKS + "<main><article>", "<h2>A second look</h2>" + _Q + _FIGURE + _L + _DL + "<pre>span: 400\nlanes: 2</pre>", "</article></main>" + _LINKS + _FORUM + "<p>&copy; 2024 The Daily</p></body></html>"),
    ("<html><body>" + _CRUMBS + "<h1>", "Bridge diary</h1><p>Monday. " + "It rained all day and nobody came to work on the bridge.</p><p>Tuesday. The sun came out and so did the engineers.</p>" + _QUOTE + "<h2>Later</h2>" + _PLAIN + _DL, "<ul>" + "<li><a href='/p'>Back</a></li>" * 8 + "</ul>" + _FORUM + "</body></html>"),
    ("<html><body><table><tr><td>" + _LINKS + "</td></tr></table><table><tr><td>", _PLAIN + _P + "<center>End of the first part of the story</center>" + _Q, "</td></tr></table>" + _SHARE + _LINKS + "</body></html>"),
    (_HEAD + _NAV + '<div class="post"><section>', "<h2>Before</h2>" + _P + "</section><section><h2>After</h2>" + _Q + _L, "</section></div>" + _COMMENTS + _FORM + _FOOT),
]
