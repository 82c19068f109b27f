"""Pages written by hand, none made by the labeller's own grammar, and the main text of each. Never trained on."""

PAGES = {
    "forum": (
        """<html><body><div id="wrap"><div id="hd"><a href="/">GardenTalk</a></div><ul class="tabs"><li><a href="/new">New</a></li><li><a href="/hot">Hot</a></li></ul>
<div class="thread"><div class="post first"><div class="user"><a href="/u/1">mossy</a></div><div class="msg"><h1>Why do my tomato leaves curl?</h1><p>I planted six tomatoes in April and since last week the upper leaves of all of them have been curling inwards.</p><p>They get water every evening. Is it the heat?</p></div></div>
<div class="replies comments"><div class="comment"><div class="user"><a href="/u/2">fern</a></div><p>Same here, I think it is the wind.</p></div></div></div><div id="ft">© 2023 GardenTalk <a href="/imprint">Imprint</a></div></div></body></html>""",
        "Why do my tomato leaves curl? I planted six tomatoes in April and since last week the upper leaves of all of them have been curling inwards. They get water every evening. Is it the heat?",
    ),
    "encyclopedia": (
        """<html><body><div id="nav"><ul><li><a href="/">Main page</a></li><li><a href="/r">Random</a></li></ul></div><div id="content"><h1>Copper</h1>
<table class="infobox"><tr><th>Symbol</th><td>Cu</td></tr><tr><th>Density</th><td>8.96 g/cm3</td></tr></table><p>Copper is a chemical element with a reddish colour. It is soft and <a href="/m">malleable</a>, and conducts heat very well.</p>
<h2>History</h2><p>It was one of the first metals that people worked, some ten thousand years ago.</p></div><div id="footer"><p>Text is available under a free licence.</p><ul><li><a href="/p">Privacy</a></li></ul></div></body></html>""",
        "Copper Symbol Cu Density 8.96 g/cm3 Copper is a chemical element with a reddish colour. It is soft and malleable, and conducts heat very well. History It was one of the first metals that people worked, some ten thousand years ago.",
    ),
    "glossary": (
        """<body><nav><a href="/a">A</a> <a href="/b">B</a></nav><main><h1>Sailing words</h1><p>These words are used on board.</p><dl><dt>Bow</dt><dd>The front of the boat.</dd><dt>Stern</dt><dd>The back of the boat, where the helm often stands.</dd></dl></main><footer>Contact us</footer></body>""",
        "Sailing words These words are used on board. Bow The front of the boat. Stern The back of the boat, where the helm often stands.",
    ),
    "german": (
        """<html lang="de"><body><div class="kopf"><a href="/">Startseite</a></div><div class="inhalt"><h1>Der See am Waldrand</h1><p>Der kleine See liegt zwei Kilometer vor dem Dorf und wird von einem Bach gespeist, der im Sommer fast austrocknet.</p><p>Im Winter friert er oft zu.</p></div><div class="fuss"><a href="/impressum">Impressum</a> <a href="/datenschutz">Datenschutz</a></div></body></html>""",
        "Der See am Waldrand Der kleine See liegt zwei Kilometer vor dem Dorf und wird von einem Bach gespeist, der im Sommer fast austrocknet. Im Winter friert er oft zu.",
    ),
    "recipe": (
        """<html><body><header><a href="/">Kitchen Notes</a><nav><a href="/soups">Soups</a><a href="/cakes">Cakes</a></nav></header><div class="container"><article class="recipe"><h1>Lentil soup</h1><p>A thick soup for cold evenings that needs half an hour.</p><h2>Ingredients</h2><ul><li>200 g red lentils</li><li>1 onion</li><li>2 carrots</li></ul><h2>Method</h2><ol><li>Chop the onion and fry it in oil.</li><li>Add lentils, carrots and a litre of water.</li><li>Cook for twenty minutes.</li></ol></article><aside class="related"><h3>Related recipes</h3><a href="/x">Pea soup</a><a href="/y">Leek soup</a></aside></div><footer><p>© Kitchen Notes, all rights reserved</p></footer></body></html>""",
        "Lentil soup A thick soup for cold evenings that needs half an hour. Ingredients 200 g red lentils 1 onion 2 carrots Method Chop the onion and fry it in oil. Add lentils, carrots and a litre of water. Cook for twenty minutes.",
    ),
    "docs": (
        """<html><body><div class="topbar"><a href="/">Docs</a><form action="/s"><input name="q"><button>Search</button></form></div><div class="layout"><div class="sidebar"><ul><li><a href="/i">Install</a></li><li><a href="/u">Usage</a></li><li><a href="/f">FAQ</a></li></ul></div><div class="main"><h1>Usage</h1><p>Call the function with the name of a file:</p><pre>read("a.csv")</pre><p>It returns a table. Columns without a name get a number.</p><h3>Errors</h3><p>A missing file ends the program.</p></div></div><div class="footer">Built with care</div></body></html>""",
        'Usage Call the function with the name of a file: read("a.csv") It returns a table. Columns without a name get a number. Errors A missing file ends the program.',
    ),
    "news": (
        """<html><body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div><header class="site-header"><a href="/">The Harbour Post</a></header><nav class="menu"><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav><main><article><h1>Bridge reopens after two years</h1><div class="byline"><span>By Ana Reis</span></div><figure><img src="b.jpg"><figcaption>The bridge on Monday morning.</figcaption></figure><p>The old bridge over the river was opened to traffic again on Monday, two years after a ship had damaged one of its pillars.</p><div class="ad">Advertisement: buy boots now</div><p>The repair cost four million.</p><blockquote>We are glad to be connected again.</blockquote></article></main><section class="comments"><h3>Comments</h3><p>Finally! says Tom</p></section><footer><a href="/about">About</a><a href="/terms">Terms</a></footer></body></html>""",
        "Bridge reopens after two years The bridge on Monday morning. The old bridge over the river was opened to traffic again on Monday, two years after a ship had damaged one of its pillars. The repair cost four million. We are glad to be connected again.",
    ),
    "french": (
        """<html lang="fr"><body><div id="entete"><a href="/">Accueil</a> <a href="/plan">Plan du site</a></div><div id="contenu"><h2>Le marché du samedi</h2><p>Chaque samedi, les producteurs de la vallée installent leurs étals sur la place de l'église dès six heures.</p><p>On y trouve des fromages, du miel et des légumes.</p><p>Il ferme à midi.</p></div><div id="pied"><a href="/mentions">Mentions légales</a></div></body></html>""",
        "Le marché du samedi Chaque samedi, les producteurs de la vallée installent leurs étals sur la place de l'église dès six heures. On y trouve des fromages, du miel et des légumes. Il ferme à midi.",
    ),
    "plain": (
        """<html><body><h1>My grandfather's clock</h1><p>The clock stood in the hall for forty years and was wound every Sunday by whoever was up first.</p><p>It stopped once, in the winter of the flood.</p><p>Nobody knows why.</p></body></html>""",
        "My grandfather's clock The clock stood in the hall for forty years and was wound every Sunday by whoever was up first. It stopped once, in the winter of the flood. Nobody knows why.",
    ),
    "hashed class names": (
        """<html><body><div class="sc-aXzGh"><div class="css-1kq"><a href="/">Home</a><a href="/l">Lists</a><a href="/p">People</a></div><div class="css-9fz"><div class="jTrwq"><h1>How bees find their way</h1><p>Bees remember the line of the horizon around their hive and compare it with what they see on the way home.</p><p>On cloudy days they use the polarised light of the sky.</p><h2>Dances</h2><p>A dance tells the others how far it is.</p></div></div><div class="css-ff2"><a href="/privacy">Privacy</a><a href="/jobs">Jobs</a></div></div></body></html>""",
        "How bees find their way Bees remember the line of the horizon around their hive and compare it with what they see on the way home. On cloudy days they use the polarised light of the sky. Dances A dance tells the others how far it is.",
    ),
    "sections": (
        """<html><body><nav class="breadcrumb"><a href="/">Home</a> › <a href="/g">Guides</a></nav><div class="content"><section><h1>Visiting the island</h1><p>The ferry leaves from the north pier at eight, ten and four, and takes about fifty minutes.</p></section><section><h2>Where to stay</h2><p>There are two inns.</p><details><summary>Prices</summary><p>A room costs between fifty and eighty a night.</p></details></section></div><div class="newsletter"><p>Subscribe to our newsletter</p><input name="email"></div><footer>© Island Guides</footer></body></html>""",
        "Visiting the island The ferry leaves from the north pier at eight, ten and four, and takes about fifty minutes. Where to stay There are two inns. Prices A room costs between fifty and eighty a night.",
    ),
    "question": (
        """<html><body><div class="navbar"><a href="/q">Questions</a><a href="/t">Tags</a></div><div class="question"><h1>How do I sharpen a plane iron?</h1><div class="votes">12</div><div class="body"><p>I bought an old plane whose iron is rusty and has a chip in its edge. I have a stone of 1000 grit and a piece of leather.</p><p>Which angle should I use?</p></div></div><div class="comments"><div class="comment">Have you looked at the manual? <a href="/u">oak</a></div></div><div class="footer"><a href="/help">Help</a></div></body></html>""",
        "How do I sharpen a plane iron? I bought an old plane whose iron is rusty and has a chip in its edge. I have a stone of 1000 grit and a piece of leather. Which angle should I use?",
    ),
    "blog with share bar": (
        """<html><body><div id="header"><h2><a href="/">Slow Travel</a></h2></div><div class="post"><h1>Three days in the hills</h1><p>We left the station at dawn and walked along the old railway until the path turned uphill.</p><p>The hut was closed, so we slept under the trees.</p><p>It rained.</p><div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div></div><div id="comments"><ol><li><p>Lovely, I want to go too!</p></li><li><p>Which hut was it?</p></li></ol><form><label>Name</label><input><button>Post comment</button></form></div><div id="sidebar"><h3>Archive</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div></body></html>""",
        "Three days in the hills We left the station at dawn and walked along the old railway until the path turned uphill. The hut was closed, so we slept under the trees. It rained.",
    ),
    "spanish": (
        """<html lang="es"><body><header class="cabecera"><a href="/">Inicio</a><a href="/blog">Blog</a></header><div class="contenido"><h1>El faro de la punta</h1><p>El faro se construyó hace más de un siglo y todavía guía a los barcos que entran en la bahía de noche.</p><ul><li>Altura: 32 metros</li><li>Alcance: 20 millas</li></ul><p>Se puede visitar los domingos.</p></div><div class="publicidad"><p>Compra ahora tu billete</p></div><footer class="pie"><p>Todos los derechos reservados</p></footer></body></html>""",
        "El faro de la punta El faro se construyó hace más de un siglo y todavía guía a los barcos que entran en la bahía de noche. Altura: 32 metros Alcance: 20 millas Se puede visitar los domingos.",
    ),
    "br paragraphs": (
        """<html><body><table><tr><td><a href="/">Index</a><br><a href="/2">Next chapter</a></td></tr></table><div><h3>Chapter One</h3>It was a bright morning when the letter came, and nobody in the house had slept well.<br><br>The letter was short. It said that the mill had been sold.</div><hr><div><a href="/">Back to index</a></div></body></html>""",
        "Chapter One It was a bright morning when the letter came, and nobody in the house had slept well. The letter was short. It said that the mill had been sold.",
    ),
    "menu only": ("""<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav><form class="login"><label>Name</label><input></form><footer>© 2020 Example <a href="/p">Privacy policy</a></footer></body></html>""", ""),
}
