"""DataFrame operators: pages to paragraphs, documents, periods and features; search; crawl frontier; trust."""
