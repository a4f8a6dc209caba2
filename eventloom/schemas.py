"""The tables that the listing engine reads and writes."""

RAW_EVENT = """source string, seq long, title string, url string, start_date string, start_time string, start_instant timestamp,
end_date date, location string, description string, speakers array<string>, free boolean, online boolean, price_text string, hints array<string>"""
SOURCE = "id string, name string, homepage string, default_free boolean, default_online boolean, default_location string"
EVENT = """id string, source string, seq long, title string, url string, date date, time string, start timestamp, location string, description string,
speakers array<string>, free boolean, online boolean, price string, also_at array<struct<source:string,url:string>>"""
HEALTH = """id string, status string, scraped long, kept long, count long, dropped map<string,long>, drop_samples array<string>"""
HISTORY = "at timestamp, ok int, empty int, failed int, events long, counts map<string,int>"
SNAPSHOT = f"source string, scraped_at timestamp, events array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in EVENT.replace(chr(10), ' ').replace('struct<source:string,url:string>', 'struct<source:string;url:string>').split(','))}>>".replace(";", ",")
