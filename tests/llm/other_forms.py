"""Sentences of other forms than the corpus's, written by hand: [value|type]. No whole value is drawn from in training,
but single given and family names (Mary, Thomas, Müller) and many groupings of digits do stand in its lists."""

SENTENCES = """
The letter was signed by [Priya Natarajan|name] and sent to [priya.n@stanford.edu|email] the same day.
Please call [07700 900123|phone] or write to [m.oconnor@dublincity.ie|email] before noon.
Her SSN [123-45-6789|id_number] was printed on the form by mistake.
The office is at [1600 Pennsylvania Avenue NW|street_address] and opens at nine.
He lived at [221B Baker Street|street_address] in London for many years.
Notre bureau se trouve [12 rue de Rivoli|street_address] à Paris.
L'ufficio si trova in [Via Roma 12|street_address] a Torino.
Ask for [Wei Zhang|name] at the desk, tel. [(212) 736-5000|phone].
My neighbour [Mary O'Connor|name] kept the old maps.
The report was written by [Emily Watson-Clarke|name] in three weeks.
Fragen Sie [Thomas Müller|name], Telefon [+49 30 901820|phone].
Contact [Bogdan Wiśniewski|name] by mail at [b.wisniewski@uw.edu.pl|email].
passport no. [C01X00T47|id_number] was found in the drawer.
Her national insurance number is [QQ 12 34 56 C|id_number] as shown.
Sein Personalausweis [T220001293|id_number] ist abgelaufen.
DNI [12345678Z|id_number], nacida en el pueblo.
Mi hermano vive en [Calle Alcalá 45|street_address] desde mayo.
Er wohnt in der [Friedrichstraße 43|street_address] seit zehn Jahren.
The parcel went to [742 Evergreen Terrace|street_address], Springfield.
Send it to [10 Downing Street|street_address] with the papers.
Visit us at [350 Fifth Avenue|street_address], floor 3.
The family moved to [4 Privet Drive|street_address] in the spring.
Appelez le [01 42 68 53 00|phone] pour une visite.
Fax [020 7946 0958|phone] is no longer in use.
text me at [415-555-2671|phone] when you arrive
reach me at [+1 650 253 0000|phone] in the morning.
Llame al teléfono [91 123 45 67|phone] por la tarde.
mobile [0412 345 678|phone] after six
Write to [office@kunsthalle-basel.ch|email] for tickets.
e-mail: [jean.dupont@orange.fr|email] merci
Contact [webmaster (at) riverside.org|email] about broken links.
Mail an [h.schroeder@uni-bonn.de|email] genügt.
My address is [kate_bell99@hotmail.com|email] and I answer daily.
The identity card [AB1234567|id_number] belongs to [Zoltán Horváth|name].
social security number [987-65-4320|id_number] given at the counter
Dr [Siobhan Gallagher|name] opened the clinic.
Professor [Akira Yamamoto|name] lectured on tides.
Met with [Isabella Marchetti|name] and [Rohan Banerjee|name] about the roof.
The photographs are by [Gunnar Lindqvist|name].
daughter of [Eduardo Villanueva|name], born in Cuzco
Dear [Abigail Pemberton|name], thank you for the book.
El autor, [Joaquín Herrera|name], murió joven.
Selon [Véronique Chevalier|name], le toit est neuf.
[Oluwaseun Adeyemi|name] said the bridge was closed.
Steuer-ID [65 929 970 489|id_number] steht oben rechts.
licence [D1234567|id_number] was renewed
Rua address: [Rua Augusta 1508|street_address], São Paulo
The shop at [88 Wentworth Road|street_address] has closed.
Deliver to [Flat 6, 27 Mill Lane|street_address], please.
Adresse: [Kastanienallee 77|street_address], Berlin
The West Carolina Railway Company opened Harbour Station in 1893.
ISBN 978-3-16-148410-0 and catalogue no. 55-7781-02 are listed.
Population 1,284,667 (1911-1921), area 55.2 km, oldid=889120034.
The British Museum and the Royal Opera House joined the Arts Council.
""".strip().splitlines()
