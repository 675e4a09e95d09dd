"""Crawl planning: settings, modes, page lists."""
