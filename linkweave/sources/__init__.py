"""Reading and writing links, requests, responses, audit events and logs."""
