"""Knowledge-archive analytics as Spark jobs: dates, places, links, works, pages, harvest."""
